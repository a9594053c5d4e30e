import bz2
import gzip
import html
import http.server
import json
import multiprocessing
import os
import shutil
import threading
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.sources import fetch, multistream, readers, tensors, writers


def test_wiki(spark, tmp_path):
    xml = "<mediawiki>" + "".join(f"<page><title>t{i}</title><ns>{i % 2}</ns><revision><id>1</id><text bytes='3'>正文{i}</text></revision></page>" for i in range(4)) + "</mediawiki>"
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert sorted(map(tuple, readers.wiki_pages(spark, str(tmp_path / "w.xml.bz2")).collect())) == [("t0", "正文0"), ("t2", "正文2")]


def test_dialogues_and_documents(spark, tmp_path):
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write('["你 好", "再 见"]\nbroken\n{"a": 1}\n["x"]\n')
    assert sorted(r["text"] for r in readers.dialogues(spark, str(tmp_path / "d.jsonl.gz")).collect()) == ["x", "你好", "再见"]
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        f.write('{"text": "a"}\nbroken\n{"text": "b", "url": 1}\n')
    assert sorted(r["text"] for r in readers.json_documents(spark, str(tmp_path / "c.json.gz")).collect()) == ["a", "b"]


def test_trees_and_globs(spark, tmp_path):
    (tmp_path / "docs/deep").mkdir(parents=True)
    (tmp_path / "docs/deep/a.md").write_text("one\ntwo")
    (tmp_path / "docs/b.txt").write_text("no")
    (tmp_path / "x_train.json").write_text("three\n")
    assert [r["text"] for r in readers.document_tree(spark, str(tmp_path / "docs")).collect()] == ["one\ntwo"]
    got = readers.selected_files(spark, [str(tmp_path / "docs")], [str(tmp_path / "*train.json")])
    assert sorted(r["line"] for r in got.collect()) == ["no", "one", "three", "two"]


def test_sets_and_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("# note\nid\tinput\tgold\tsyllables\ttags\n\n1\tab\t甲乙\t2\tx\n2\tc\t丙\t1\ty\t前文\n")
    assert sorted(map(tuple, readers.evaluation_set(spark, str(tmp_path / "s.tsv")).collect())) == [("1", "ab", "甲乙", 2, "x", ""), ("2", "c", "丙", 1, "y", "前文")]
    (tmp_path / "t.tsv.bz2").write_bytes(bz2.compress('1\tcmn\t"你好\n2\tfra\tsalut\n'.encode()))
    assert [tuple(r) for r in readers.tagged_sentences(spark, str(tmp_path / "t.tsv.bz2"), "cmn").collect()] == [(1, '"你好')]
    (tmp_path / "f.txt").write_bytes("中\tzhong\t9\n钟\tzhong\t7\n中国\tzhong guo\t5\n终\tzhong\t8\n".encode("utf-16-le"))
    assert sorted((r["rank"], r["ch"]) for r in readers.frequency_table(spark, str(tmp_path / "f.txt"), 2).collect()) == [(0, "中"), (1, "终")]
    (tmp_path / "m.arpa").write_text("\\data\\\nngram 1=2\n\n\\1-grams:\n-1.5\t中\t-0.3\n-2.0\t国\n\n\\2-grams:\n-0.5\t中 国\n\\end\\\n")
    assert sorted(map(tuple, readers.arpa_ngrams(spark, str(tmp_path / "m.arpa")).collect()), key=str) == [("中", -1.5, -0.3), ("国", -2.0, None)]
    assert [r["ngram"] for r in readers.arpa_ngrams(spark, str(tmp_path / "m.arpa"), 2).collect()] == ["中 国"]


def test_dictionary(spark, tmp_path):
    rows = spark.createDataFrame([("ni'hao", "nh", "你好", 9), ("ni'hao'ma", "nhm", "你好吗", 5), ("ni", "n", "你", 8), ("wo", "w", "我", 3)], "key string, jp string, value string, weight long")
    readers.write_dictionary(rows, str(tmp_path / "dict"))
    assert [r["value"] for r in readers.look_up(spark, str(tmp_path / "dict"), "ni'hao").collect()] == ["你好"]
    assert [r["value"] for r in readers.look_up(spark, str(tmp_path / "dict"), "ni'hao", prefix=True).collect()] == ["你好", "你好吗"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/dev.json", json.dumps([["a", "b"], ["c"]]))
        z.writestr("y/readme", "no")
    (tmp_path / "b.zip").write_bytes(b"broken")
    got = readers.archived_dialogues(spark, f"{tmp_path}/*.zip", "dev.json", readers.turns_of_lists)
    assert sorted((r["unit"], r["turn"], r["text"]) for r in got.collect()) == [("0", 0, "a"), ("0", 1, "b"), ("1", 0, "c")]
    assert readers.turns_of_messages({"u": {"messages": [{"message": "m"}, {}]}}) == [("u", 0, "m")]
    assert readers.turns_of_contents([{"id": 5, "content": ["p", "q"]}]) == [("5", 0, "p"), ("5", 1, "q")]


def test_model_table(spark, tmp_path):
    (tmp_path / "m.safetensors").write_bytes(tensors.build({"w": np.ones((2, 2), "f4")}, {}))
    got = readers.model_tensors(spark, str(tmp_path / "m.safetensors")).first()
    assert (got["name"], got["shape"], got["values"]) == ("w", [2, 2], [1.0] * 4)


def test_nested_divisions(spark):
    html = '<p>out</p><div id="C"><p>a &amp; b</p><div><p>in</p></div><p> last </p></div><p>after</p></div>'
    got = readers.content_paragraphs(spark.createDataFrame([(1, html), (2, "<p>x</p>")], "id int, html string"), "html", '<div id="C">')
    assert [(r["id"], r["text"]) for r in got.orderBy("id", "pos").collect()] == [(1, "a & b"), (1, "in"), (1, "last")]


def test_divisions_in_capitals(spark):
    from pyspark.sql import functions as F

    from corpuslab.sources.pages import balanced_div

    html = '<div id="C">a<DIV>b</DIV><divider>c</divider><Div x="1">d</div>e</DIV>f</div>'
    assert spark.createDataFrame([(html,)], "h string").select(balanced_div(F.col("h"), '<div id="C">')).first()[0] == 'a<DIV>b</DIV><divider>c</divider><Div x="1">d</div>e'


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("one",), ("two",)], "line string")
    writers.write_corpus(lines, str(tmp_path / "c"), {"name": "n", "license": "MIT", "share_alike": False})
    assert json.loads(spark.read.text(str(tmp_path / "c.source")).first()[0]) == {"name": "n", "license": "MIT", "share_alike": False, "lines": 2, "chars": 6}
    cases = spark.createDataFrame([(1, "g", "a\nb")], "id int, gold string, context string")
    writers.write_cases(cases, str(tmp_path / "j"), str(tmp_path / "t"), ["id", "gold", "context"], ["context"])
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "1\tg\ta\\nb"
    with pytest.raises(ValueError):
        writers.write_cases(cases, str(tmp_path / "j"), str(tmp_path / "t"), ["id", "context"])
    picks = spark.createDataFrame([(1, 0), (2, 1)], "id int, pick int")
    assert [writers.append_missing(picks, str(tmp_path / "p"), "id"), writers.append_missing(picks, str(tmp_path / "p"), "id")] == [2, 0]
    writers.write_results(picks, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2


def test_download(tmp_path):
    data = bytes(range(256)) * 400
    seen = []

    class Serve(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            have = int((self.headers.get("Range") or "bytes=0-").split("=")[1].split("-")[0])
            seen.append(have)
            resume = self.path == "/resume"
            body = data[have:] if resume and have else data
            self.send_response(206 if resume and have else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body[:50000] if len(seen) == 1 else body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Serve)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert fetch.download(f"{base}/resume", tmp_path / "a", wait=0).read_bytes() == data and seen == [0, 50000]
    (tmp_path / "b.part").write_bytes(b"xx")
    assert fetch.download(f"{base}/plain", tmp_path / "b", wait=0).read_bytes() == data
    server.shutdown()
    assert list(fetch.paged(lambda n: [9 - 2 * n, 8 - 2 * n], lambda r: r < 6)) == [9, 8, 7, 6]


def test_runs_of_text_bodies(spark, tmp_path):
    body = "<mediawiki><page><title>a</title><ns>0</ns><revision><text bytes=\"9\">一二[[三]]\n四五 &lt;b&gt;六</text></revision></page>\n<page><title>b</title><ns>4</ns><revision><text>七</text></revision></page>\n<page><revision><text /></revision></page></mediawiki>"
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(body.encode()))
    got = readers.wiki_runs(spark, str(tmp_path / "dump.xml.bz2")).orderBy("text", "pos").collect()
    runs = {}
    for r in got:
        runs.setdefault(r["text"], []).append(r["run"])
    assert sorted(runs.values()) == [["一二", "三", "四五", "六"], ["七"]]


def test_finished_chunks_are_skipped(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3 if i else None) for i in range(10)], "id long, chunk long")
    path = str(tmp_path / "out")
    assert writers.write_missing_chunks(rows, "chunk", path) == 4
    shutil.rmtree(tmp_path / "out" / "chunk=1")
    assert writers.write_missing_chunks(rows, "chunk", path) == 1
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "chunk").collect()) == sorted(tuple(r) for r in rows.collect())
    assert writers.write_missing_chunks(rows, "chunk", path) == 0
    assert writers.write_missing_chunks(rows.where("false"), "chunk", path) == 0


def test_a_run_that_broke_off_is_resumed(spark, tmp_path):
    """Chunks that were ready when another failed are there, whole, and aren't computed again."""
    path, log = str(tmp_path / "out"), tmp_path / "log"
    log.mkdir()
    rows = spark.range(400).select("id", (F.col("id") % 8).cast("string").alias("chunk"))

    def work(fails):
        def run(batches):
            for pdf in batches:
                for c in set(pdf["chunk"]):
                    if c == fails:
                        time.sleep(6)
                        raise ValueError("broken off")
                    (log / f"{fails}-{c}").touch()
                yield pdf.assign(twice=2 * pdf["id"])

        return lambda df: df.mapInPandas(run, "id long, chunk string, twice long")

    with pytest.raises(Exception, match="broken off"):
        writers.write_missing_chunks(rows, "chunk", path, work("5"), 8)
    ready = {p.name.removeprefix("chunk=") for p in (tmp_path / "out").glob("chunk=*")}
    assert ready and "5" not in ready
    missing = 8 - len(ready)
    assert writers.write_missing_chunks(rows, "chunk", path, work(None), 8) == missing
    assert {p.name for p in log.glob("None-*")} == {f"None-{c}" for c in "01234567" if c not in ready}
    got = spark.read.schema("id long, twice long, chunk string").parquet(path).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, 2 * i, str(i % 8)) for i in range(400))


def merged(path, own):
    shared = writers.SharedProgress(path)
    for i in range(25):
        shared.merge({f"{own}-{i}": i})


def test_progress_of_several_writers(tmp_path):
    path = str(tmp_path / "progress")
    workers = [multiprocessing.get_context("spawn").Process(target=merged, args=(path, w)) for w in "abc"]
    for w in workers:
        w.start()
    for w in workers:
        w.join(120)
        assert w.exitcode == 0
    shared = writers.SharedProgress(path)
    assert shared.read() == {f"{w}-{i}": i for w in "abc" for i in range(25)}
    assert len(list((tmp_path / "progress").iterdir())) <= shared.KEPT + 3 and shared.merge({"a-0": "new"}) >= 76 and shared.read()["a-0"] == "new"


def test_a_slow_writer_loses_nothing(tmp_path, monkeypatch):
    """It read a state whose successors were put, and deleted, before it put its own."""
    slow, quick = (writers.SharedProgress(str(tmp_path)) for _ in range(2))
    quick.merge({"first": 1})
    real, once = slow._last, []

    def last():
        out = real()
        if not once:
            once.append(1)
            for i in range(20):
                quick.merge({"q": i})
        return out

    monkeypatch.setattr(slow, "_last", last)
    slow.merge({"s": "mine"})
    assert quick.read() == {"first": 1, "q": 19, "s": "mine"}


def test_progress_in_a_store_behind_spark(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.SharedProgress("hdfs://x/y")
    monkey = writers.SharedProgress(f"file://{tmp_path}/p", spark)
    monkey.path = f"file://{tmp_path}/p"  # through Hadoop's file system
    assert monkey.read() == {} and monkey.merge({"a": 1}) == 1 and monkey.merge({"b": [2]}) == 2 and monkey.read() == {"a": 1, "b": [2]}


def dump(tmp_path, streams=8, each=5):
    """A dump of streams, its index, and its pages."""
    raw, index, pages, at = b"", [], [], 0
    texts = [bz2.compress(b"<mediawiki>\n<siteinfo/>\n")]
    for s in range(streams):
        own = []
        for i in range(each):
            n = s * each + i
            body = f"正文 {n} &lt;b&gt; &amp;amp;" + "x" * (n * 700)
            text = f"<text bytes='9'>{body}</text>" if n % 7 else "<text bytes='0' />"
            own.append(f"  <page>\n    <title>T&amp;{n}</title>\n    <ns>{n % 2}</ns>\n    <revision><id>1</id>{text}</revision>\n  </page>\n")
            pages.append((f"T&{n}", n % 2, html.unescape(body) if n % 7 else ""))
        texts.append(bz2.compress("".join(own).encode()))
    texts.append(bz2.compress(b"</mediawiki>"))
    for k, t in enumerate(texts):
        if 0 < k <= streams:
            index += [f"{at}:{k * each + i}:T&amp;{k}:x" for i in range(each)]
        raw, at = raw + t, at + len(t)
    (tmp_path / "d.xml.bz2").write_bytes(raw)
    (tmp_path / "i.txt.bz2").write_bytes(bz2.compress("\n".join(index).encode()))
    return str(tmp_path / "d.xml.bz2"), str(tmp_path / "i.txt.bz2"), pages


def test_streams_that_are_written(spark, tmp_path):
    """Put one after the other they are a dump."""
    rows = [(i, f"T<{i}>&", i % 2, None if i == 3 else f"<text>&amp;{i}</text></page>" * i) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, t string, n int, b string")
    streams = multistream.written_streams(df, (F.col("t"), F.col("n"), F.col("b")), ["id"], 5).orderBy("stream").collect()
    assert [r["stream"] for r in streams] == [0, 1, 2, 3, 4]
    (tmp_path / "d.bz2").write_bytes(b"".join(bytes(r["raw"]) for r in streams))
    want = [(t, n, b or "") for _, t, n, b in rows]
    assert [tuple(r) for r in multistream.multistream_pages(spark, str(tmp_path / "d.bz2"), namespace=None).collect()] == want
    own = multistream.pages_in_streams(spark.createDataFrame(streams), namespace=1)
    assert sorted(map(tuple, own.collect())) == sorted(x for x in want if x[1] == 1)


def test_dump_of_streams(spark, tmp_path, monkeypatch):
    path, index, pages = dump(tmp_path)
    got = multistream.multistream_pages(spark, path, index, None)
    assert got.rdd.getNumPartitions() == 8 and [tuple(r) for r in got.collect()] == pages
    by = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sorted(r["count"] for r in by) == [5] * 8
    assert sorted(map(tuple, multistream.multistream_pages(spark, path, index, streams=3).collect())) == sorted(p for p in pages if p[1] == 0)
    for size in (1, 10, 300, 1 << 30):  # without an index: streams of the ranges they begin in
        some = multistream.multistream_pages(spark, path, None, None, range_bytes=max(size, 200))
        assert sorted(map(tuple, some.collect())) == sorted(pages)
    monkeypatch.setattr(multistream, "PIECE", 64)  # pages lie across pieces, and signatures too
    reader = multistream.MultistreamReader({"path": path, "namespace": "1"})
    assert list(reader.read(multistream.Streams(begin=0, end=1 << 30))) == [p for p in pages if p[1] == 1]
    with open(path, "rb+") as f:
        f.truncate(os.path.getsize(path) - 10)
    with pytest.raises(EOFError):
        list(reader.read(multistream.Streams(begin=0, end=1 << 30)))
    (tmp_path / "empty.bz2").write_bytes(b"")
    assert multistream.multistream_pages(spark, str(tmp_path / "empty.bz2")).collect() == []


def test_sqlite_lookups(spark, tmp_path):
    import sqlite3

    from corpuslab.sources import sqlite

    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        for name, rows in {"tbl_2_n": [("nihk", "nh", "你好", 9), ("nihx", "nh", "拟好", None)], "tbl_others_n": [("nihkma" * 3, "n", "长", 1)], "tbl_1_w": []}.items():
            c.execute(f"create table {name} (key text, jp text, value text, weight integer)")
            c.executemany(f"insert into {name} values (?, ?, ?, ?)", rows)
    found = lambda key: sorted(r["value"] for r in sqlite.look_up_in_sqlite(spark, path, key).collect())
    assert [found("nihk"), found("ni"), found("wo"), found("nihkma" * 3)] == [["你好"], [], [], ["长"]]
    every = sqlite.sqlite_tables(spark, path, "value string, weight long")
    assert sorted(tuple(r) for r in every.na.fill(-1).collect()) == [("你好", 9), ("拟好", -1), ("长", 1)]


def test_corpus_batches(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\n".join(f"l{i}" for i in range(10)) + "\n")
    got = readers.corpus_batches(spark, str(tmp_path / "c.txt"), 4).orderBy("part", "batch", "pos").collect()
    assert [(r["batch"], r["pos"], r["line"]) for r in got] == [(i // 4, i % 4, f"l{i}") for i in range(10)]


def test_character_references(spark):
    import html

    from pyspark.sql import functions as F

    from corpuslab.sources.pages import unescape

    texts = ["", "a & b &", "&amp;lt; &lt;p&gt;", "&nbsp;&eacute;&Eacute&copy2&notit;&notin;&bogus;&bogus", "&#65;&#x41;&#X4a &#0;&#128;&#159;&#13;&#55296;&#1114112;&#99999999999999999999;&#x1F600;&#11;&#64976;&#65534;&#;&#x;", "&#0000000000000000065;", "&&amp;&", "a\u0000&quot;\n&hellip;", "&NotEqualTilde;&b.Theta;&frac12x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", unescape(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in got] == [*map(html.unescape, texts), None]
