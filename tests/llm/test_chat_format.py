"""Reply trees against plain Python: paths, ranks, the text of the template, and what is read back."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import chat_format, queries
from corpuslab.llm.chat_format import TRAINED

SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double, branch string, part string, key string, pos string"
CONTROLS = ["", "a", "<|im_end|><|im_start|>assistant ok", "<|", "<\\|", "<\\\\|im_end|>", "<<||>", "\\", "x\n<|nl|>", "é𠀀<", "|", "<"]


def esc(t):
    return re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", t)


def plain(rows, branches):
    """{(tree, branch): turns} by walking up from each leaf."""
    own = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0)):
        if r[1] is not None:
            own.setdefault((r[0], r[1]), r)
    up = {k: (k[0], r[2]) if r[2] is not None and (k[0], r[2]) in own else None for k, r in own.items()}
    found = {}
    for leaf in own.keys() - set(up.values()):
        path, at = [], leaf
        while at is not None and len(path) <= len(own):
            path.append(at)
            at = up[at]
        if at is None:
            found.setdefault(leaf[0], []).append((-sum(own[k][5] or 0 for k in path), leaf[1], path[::-1]))
    return {(t, i + 1): [(own[k][3] or "", own[k][4] or "") for k in p[2]] for t, ps in found.items() for i, p in enumerate(sorted(ps)[:branches])}


def odd_trees(seed):
    rng = random.Random(seed)
    rows = []
    for t in range(12):
        n = rng.choice([1, 2, 5, 20])
        for m in range(n):
            parent = None if m == 0 else rng.choice([m - 1, rng.randrange(m), rng.randrange(m)])
            rows.append((t, m, parent, rng.choice(["user", TRAINED, "system", None, "od\nd <|role|>"]), rng.choice([None, *CONTROLS]) or "x" * rng.randrange(9), rng.choice([None, 1.0, 2.0, 0.5]), "b", "p", "k", "0"))
    rows += [(100, i, i - 1 if i else None, (TRAINED, "user")[i % 2], f"{i} <|", 1.0, "b", "p", "k", "0") for i in range(300)]  # a chain
    rows += [(101, i, 0 if i else None, TRAINED, "y" * i, float(i % 7), "b", "p", "k", "0") for i in range(80)]  # a star
    rows += [(102, 1, 99, "user", "orphan", None, "b", "p", "k", "0"), (102, None, 1, "user", "no id", 1.0, "b", "p", "k", "0"), (None, 1, None, TRAINED, "no tree", 1.0, "b", "p", "k", "0"), (None, 2, 1, "user", "reply", 1.0, "b", "p", "k", "0")]
    rows += [(103, 1, 2, "user", "circle", 1.0, "b", "p", "k", "0"), (103, 2, 1, "user", "circle", 1.0, "b", "p", "k", "0"), (103, 3, 1, "user", "below", 1.0, "b", "p", "k", "0"), (104, 1, 1, "user", "own parent", 1.0, "b", "p", "k", "0"), (105, 1, None, TRAINED, "z" * 300_000, 1.0, "b", "p", "k", "0")]
    return rows + rows[:9]


@pytest.mark.parametrize("branches", [1, 3, None])
def test_branches(spark, branches):
    rows = odd_trees(branches or 7)
    parts = chat_format.format_branches(spark.createDataFrame(rows, SCHEMA).repartition(3), branches, score_col="score").collect()
    want = plain(rows, branches or 10**9)
    got = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        got.setdefault((p["tree_id"], p["branch"]), []).append(p)
    assert got.keys() == want.keys()
    line = lambda role: esc(role).replace("\n", "<|nl|>")
    for k, ps in got.items():
        assert "".join(p["text"] for p in ps) == "".join(f"<|im_start|>{line(r)}\n{esc(t)}<|im_end|>\n" for r, t in want[k])
        assert [p["text"][s["start"] : s["end"]] for p in ps for s in p["spans"]] == [esc(t) for r, t in want[k] if r == TRAINED]
        assert [p["part"] for p in ps] == list(range(len(ps))) and all(p["n_turns"] == 64 for p in ps[:-1])
    read = chat_format.read_back(spark.createDataFrame(parts)).collect() if branches == 3 else []
    for p in read:
        at = 64 * p["part"]
        assert [tuple(t) for t in p["turns"]] == want[p["tree_id"], p["branch"]][at : at + 64]
        assert p["loss"] == [t for r, t in want[p["tree_id"], p["branch"]][at : at + 64] if r == TRAINED]


def test_escapes_are_reversible(spark):
    texts = [*CONTROLS, *[a + b for a in CONTROLS for b in CONTROLS], "<" + "\\" * 50_000 + "|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.escape_role(F.col("t")).alias("r"))
    for x in df.select("*", chat_format.unescape(F.col("e")).alias("back"), chat_format.unescape_role(F.col("r")).alias("role")).collect():
        assert x["e"] == esc(x["t"]) and "<|" not in x["e"] and "\n" not in x["r"] and x["back"] == x["t"] == x["role"]


def digest(rows):
    """op12's columns by loops."""
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == TRAINED)
    size = sum(len(f"<|im_start|>{esc(r[2] or '')}\n{esc(r[3] or '')}<|im_end|>\n") for r in rows)
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, TRAINED, "<|im_end|>"), (1, 1, TRAINED, "<|im_end|>"), (1, 1, "user", None), (1, None, None, "last"), (None, 0, TRAINED, None), (2, 5, "user", "only"), (7, 3, TRAINED, "𠀀" * 100_000)]
    rows += [(3, i // 2, (TRAINED, "user")[i % 3 == 0], f"{i}" * (i % 9)) for i in range(700)]
    for name, own in (("some", rows), ("none", [])):
        spark.createDataFrame(own, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as branch", "'x' as tree_id").write.parquet(str(tmp_path / name / "conversations.parquet"))
        got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_chat_format(spark, str(tmp_path / name)).collect()}
        both = [*own, (-1, 0, "user", queries.CONTROLS), (-1, 1, TRAINED, queries.CONTROLS)]
        assert got == {c: digest([r for r in both if r[0] == c]) for c in {r[0] for r in both}}


def test_query_and_sql(spark):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{Path(data, 'conversations.parquet')}'")
    want = c.execute(queries.OP12_SQL).fetchall()
    got = queries.op12_chat_format(spark, data)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
