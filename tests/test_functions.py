import html
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import presets as P
from corpuslab.functions import stats as A
from corpuslab.functions import tensor as M
from corpuslab.functions import text as X
from corpuslab.sources import pages


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_connected_han_runs(spark):
    assert one(spark, "山水ABC，输入法123！\nABC\n𠀀中文\n", X.connected_runs) == ["山水", "输入法", "𠀀中文"]
    assert one(spark, "山水ABC，输入法123！\n𠀀中文", X.script_runs) == ["山水", "输入法", "中文"]


def test_spacing_and_clipping(spark):
    assert one(spark, "山水输入法", X.spaced) == "山 水 输 入 法"
    assert one(spark, "", X.spaced) == ""
    assert [len(p) for p in one(spark, "字" * 195, X.clip_run)] == [96, 96]
    assert one(spark, "字字字", X.clip_run) == [] and one(spark, "", X.clip_run) == []
    assert one(spark, "推 动 田 管", X.repair_spacing) == "推动田管"
    assert one(spark, "a b", X.repair_spacing) == "a b"


def test_markers_and_prose(spark):
    assert one(spark, "們" + "字" * 99, X.marker_share) == 0.01
    assert one(spark, "", X.marker_share) == 0.0
    assert one(spark, "字" * 64, X.is_prose) and not one(spark, "字" * 63, X.is_prose)
    assert not one(spark, "字a" * 80, X.is_prose)  # no long run
    assert one(spark, "买彩票", X.is_spam) and not one(spark, "买票", X.is_spam)


def test_markup(spark):
    raw = "[[a|标签]] <ref>x</ref>{{t|{{u}}}} <b>粗</b> &lt;"
    assert one(spark, raw, X.strip_wikitext).split() == ["标签", "粗", "<"]
    assert one(spark, "[文](http://x) `c` ```\ncode\n``` 字", X.strip_markdown).split() == ["文", "字"]


def test_clauses(spark):
    got = lambda s, **k: [(c["start"], c["clause"]) for c in one(spark, s, lambda t: X.clauses(t, **k))]
    assert got("今天天气很好，我们出去玩吧。短") == [(0, "今天天气很好"), (7, "我们出去玩吧")]
    assert got("今天天气很好，我们出去玩吧。短句子啊", strict=True) == [(7, "我们出去玩吧")]
    assert got("前a今天天气很好，") == []


def test_tails_and_contexts(spark):
    assert one(spark, "ab山水", lambda t: X.byte_tail(t, 4)) == "水"
    assert one(spark, "ab山水", lambda t: X.byte_tail(t, 100)) == "ab山水"
    assert one(spark, "a�b", lambda t: X.byte_tail(t, 4)) == "�b"
    assert one(spark, "x" * 100, lambda t: X.rerank_context(t, 64, F.lit(9))) == "x" * 48
    assert one(spark, "山水ABC", lambda t: X.char_tail(t, 4)) == "水ABC"
    assert one(spark, "abcdefg", X.char_windows) == [] and one(spark, "abcdefghi", X.char_windows) == ["abcdefgh", "bcdefghi"]


def test_keys(spark):
    keys = {"n": "nn", "li": "li", "ang": "ah", "shuang": "ul", "zhong": "vs", "tian": "tm"}
    for s, want in keys.items():
        assert one(spark, s, X.double_key) == want
    r = F.array(*map(F.lit, ("shui", "shan")))
    assert one(spark, "", lambda t: X.typed_key(r, "full")) == "shuishan"
    assert one(spark, "", lambda t: X.typed_key(r, "initials")) == "ss"
    assert one(spark, "seed", lambda t: X.typed_key(r, "mixed", t)) in ("shuis", "sshan")
    assert one(spark, "a'z?", X.letter_ids) == [1, 27, 26, 0]
    assert one(spark, "xiangan", lambda t: X.greedy_syllables(t, ("xi", "an", "xian", "gan"))) == ["xian", "gan"]
    assert one(spark, "xianq", lambda t: X.greedy_syllables(t, ("xi", "an"))) is None


def test_swaps_and_json(spark):
    same = lambda a, b: one(spark, "", lambda t: X.differs_only_in(F.lit(a), F.lit(b)))
    assert same("他来了", "她来了") and not same("他来了", "他来了") and not same("他来了", "我来了") and not same("他", "她他")
    assert one(spark, 'x {"a": {"b": 1}} y', X.json_slice) == '{"a": {"b": 1}}' and one(spark, "}{", X.json_slice) is None


@pytest.mark.parametrize("a,b,p", [(0, 0, 1), (3, 0, 0.25), (1, 0, 1), (5, 0, 0.0625), (10, 0, 0.001953125), (4, 4, 1), (0, 5, 0.0625)])
def test_mcnemar(spark, a, b, p):
    assert one(spark, "", lambda t: A.mcnemar(F.lit(a), F.lit(b))) == pytest.approx(p, rel=1e-12)


def test_mcnemar_of_many(spark):
    n, k = 3000, 1400
    want = min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert one(spark, "", lambda t: A.mcnemar(F.lit(n - k), F.lit(k))) == pytest.approx(want, rel=1e-9)


def test_wilson_and_power(spark):
    low, high = A.wilson(F.lit(49.0), F.lit(52.0))
    assert (one(spark, "", lambda t: low), one(spark, "", lambda t: high)) == (0.8436, 0.9802)
    low, high = A.wilson(F.lit(0.0), F.lit(0.0))
    assert (one(spark, "", lambda t: low), one(spark, "", lambda t: high)) == (0.0, 0.0)
    assert round(one(spark, "", lambda t: A.cases_needed(F.lit(0.06), F.lit(0.01))), -1) == 4670
    assert round(one(spark, "", lambda t: A.detectable_net(F.lit(1196), F.lit(0.032))), 3) == 0.014


def test_sizes_of_published_shapes(spark):
    for shape, want in (((8192, 64, 6, 256), 6846464), ((12288, 128, 8, 448), 24863104), ((8192, 64, 6, 192), 4250112)):
        assert one(spark, "", lambda t: A.transformer_parameters(*map(F.lit, shape))) == want


def test_tensors(spark):
    a = F.array(*map(F.lit, (1.0, -2.0, 0.5)))
    q = one(spark, "", lambda t: M.quantize_int8(a))
    assert q["values"] == [64, -127, 32] and q["scale"] == pytest.approx(2 / 127)
    assert sum(one(spark, "", lambda t: M.softmax(a))) == pytest.approx(1)
    assert one(spark, "", lambda t: M.gelu(F.lit(1.0))) == pytest.approx(0.841345, abs=1e-6)
    assert one(spark, "abc", lambda t: F.sha2(t, 256)) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_layer_norm_takes_mean_and_deviation_once(spark):
    def plain(a):
        some = [x for x in a if x is not None]
        mean = sum(some) / len(a)
        dev = math.sqrt(sum((x - mean) ** 2 for x in some) / len(a) + 1e-5)
        return [None if x is None else (x - mean) / dev for x in a]

    long = [float(i * i % 97) for i in range(768)]
    rows = [(0, long), (1, [1.0, None, 4.0]), (2, [3.5]), (3, []), (4, None), (5, [None, None])]
    df = spark.createDataFrame(rows, "id int, a array<float>").select("id", M.layer_norm(F.col("a")).alias("b"))
    df.where("id = 2").collect()
    began = time.perf_counter()
    got = {r["id"]: r["b"] for r in df.collect()}
    assert time.perf_counter() - began < 4
    for i, a in rows:
        want = a and [x if x is None else pytest.approx(x) for x in plain(a)]
        assert got[i] == want


def test_license_policy(spark):
    assert one(spark, "MIT", X.is_permissive) and not one(spark, "GPL-3.0", X.is_permissive)
    assert one(spark, "uses Wikipedia text", X.is_share_alike) and not one(spark, "own text", X.is_share_alike)
    assert len(set(P.HAN.markers)) > 100


def test_templates_of_any_depth(spark):
    deep = "a " + "{{x " * 40 + "mid" + " }}" * 40 + " b {{open {{in}} c"
    got = spark.createDataFrame([(deep,), (None,), ("plain",), ("}} {{",)], "t string").select(X.strip_wikitext(F.col("t"))).collect()
    assert [r[0] and r[0].split() for r in got] == [["a", "b", "{{open", "c"], None, ["plain"], ["}}", "{{"]]


def test_tokens_are_counted_within_a_text(spark):
    from corpuslab.operators.corpus import vocabulary

    rows = [("abca",), ("",), (None,), ("aa\U0001f600",)]
    got = vocabulary(spark.createDataFrame(rows, "t string"), "t", 10).where("token_id > 2").collect()
    assert [(r["token"], r["n"]) for r in sorted(got, key=lambda r: r["token_id"])] == [("a", 4), ("b", 1), ("c", 1), ("\U0001f600", 1)]


def plain_templates(text):
    """Rounds of replacement until nothing changes."""
    while (after := re.sub(r"\{\{[^{}]*\}\}", " ", text)) != text:
        text = after
    return text


def test_templates_go_in_one_pass(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("{{{}}}}ab\n") for _ in range(r.randrange(40))) for _ in range(20_000)]
    texts += ["", "{{{x}}}", "{{a{b}}}", "{{a{{b}}c}} d", "}}{{", "{{}}", "{ {a} }", "{{{{a}}}}", "{{{a}}b}}"]
    assert [X.without_templates(t) for t in texts] == [plain_templates(t) for t in texts]
    deep = "{{" * 100_000 + "x" + "}}" * 100_000
    began = time.perf_counter()
    assert X.without_templates(deep) == " " and X.without_templates("}}" * 250_000 + "{{" * 250_000) == "}}" * 250_000 + "{{" * 250_000
    assert time.perf_counter() - began < 4
    got = spark.createDataFrame([(1, "a {{b}} c"), (2, None), (3, "{{")], "id int, t string").select("id", X.strip_templates(F.col("t")).alias("t")).collect()
    assert {x["id"]: x["t"] for x in got} == {1: "a   c", 2: None, 3: "{{"}


def test_divisions_and_references(spark):
    div = '<div class="ad">'
    cases = {
        f"x{div}a\x01b</div>c": "a\x01b", f"{div}a<div>b</div>c</div>d</div>": "a<div>b</div>c", f"{div}<DIV>𠀀</DIV>y</Div>z": "<DIV>𠀀</DIV>y", f"{div}open <div>": "open <div>",
        "none": "", f"{div}</div>{div}second</div>": "", f"{div}<divider>k</div>": "<divider>k", f"{div}": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "h string").select("h", pages.balanced_div(F.col("h"), div).alias("d")).collect()
    assert {x["h"]: x["d"] for x in got} == cases
    many = f"{div}" + "<div>a</div>" * 20_000 + "</div>tail"
    assert spark.createDataFrame([(many,)], "h string").select(F.length(pages.balanced_div(F.col("h"), div)).alias("n")).first()["n"] == 12 * 20_000
    names = [f"a&{n} b" for n in html.entities.html5] + ["&notit;", "&amp", "&AMP;&lt;", "&#x41;&#65;&#0;&#128;", "&unknown;", "no reference", "&"]
    back = spark.createDataFrame([(n,) for n in names], "n string").select("n", pages.unescape(F.col("n")).alias("u")).collect()
    assert all(x["u"] == html.unescape(x["n"]) for x in back)
