"""WARC archives, the audit of sources and the prefix trie, against plain versions, on the
smallest tables and on rows with nulls, ties, repeats, odd characters and other columns."""

import collections
import gzip
import hashlib
import json
import re
import zlib
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tramline.llm import divergence, lines, prefix_trie, queries, shared, warc
from tramline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def _run(spark, name):
    return sorted((tuple(x) for x in QUERIES[name](spark, FOLDER).collect()), key=repr)


# --- archives


def _plain_archive(rows):
    """(page_id, bytes, digest, type, refers_to) of (page_id, url, html) rows."""
    last = 1 << 63
    order = sorted(rows, key=lambda x: (last if x[0] is None else x[0], x[1] is not None, x[1] or ""))
    first, out = {}, []
    for page, _, html in order:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in first
        out.append((page, len(data), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, page)
    return sorted(out, key=repr)


LONG = "<html>" + "é" * 60 + "</html>"
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3 x\r\ny", LONG), (3, "http://a/3", LONG), (3, None, LONG), (None, "http://n", LONG), (None, None, LONG), (7, "http://b", "short"), (8, "http://c", "short"),
    (9, None, None), (10, "", ""), (11, "http://z", "\r\n\r\nWARC/1.1\r\n" * 9), (12, "http://z", "\r\n\r\nWARC/1.1\r\n" * 9), (None, "http://q", "only without an id" * 9), (None, "http://q", "only without an id" * 9),
    (-4, "http://neg", "y" * 100), (2, "http://neg", "y" * 100), (1, "http://neg", "y" * 99), (0, "http://neg", "y" * 99), (1 << 62, "http://big", "b" * 200_000), (13, "http://big", "b" * 200_000),
]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("other")).withColumn("shard", F.lit("other")).repartition(3)


def _records(df):
    return sorted((tuple(x) for x in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_op11(spark):
    assert _run(spark, "op11_warc") == _plain_archive([(x["page_id"], x["url"], x["html"]) for x in _table("pages")])


@pytest.mark.parametrize("shard_bytes,roll_bytes", [(64 << 20, 256 << 20), (300, 400)])
def test_archives_of_odd_rows(spark, tmp_path, shard_bytes, roll_bytes):
    folder = warc.write_archives(_pages(spark, ROWS), f"file://{tmp_path}/a", shard_bytes=shard_bytes, roll_bytes=roll_bytes)
    assert _records(warc.read_archives(spark, folder)) == _plain_archive(ROWS)
    assert not list((tmp_path / "a" / "_temporary").iterdir())
    manifest = [json.loads(x) for x in (tmp_path / "a" / "manifest.jsonl").read_text().splitlines()]
    assert sum(x["records"] for x in manifest) == len(ROWS) and (len(manifest) > 3) == (roll_bytes == 400)
    for x in manifest:
        data = (tmp_path / "a" / x["path"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (x["bytes"], x["sha256"])
    firsts = [x["first_page"] for x in manifest]
    assert firsts == sorted(firsts) and all(x["first_page"] <= x["last_page"] for x in manifest)


def test_archives_are_the_same_every_time(spark, tmp_path):
    rows = [(k, f"http://s/{k % 17}", f"<p>{k % 40}</p>" * (k % 90)) for k in range(600)]
    texts = []
    for name, parts in (("a", 2), ("b", 7)):
        pages = spark.createDataFrame(rows if name == "a" else rows[::-1], "page_id long, url string, html string").repartition(parts)
        warc.write_archives(pages, f"file://{tmp_path}/{name}", shard_bytes=20_000, roll_bytes=2000)
        texts.append({x.name: x.read_bytes() for x in (tmp_path / name).iterdir() if x.is_file() and not x.name.startswith(".")})
    assert texts[0] == texts[1] and len(texts[0]) > 10


def test_archive_files_are_plain_warc(spark, tmp_path):
    warc.write_archives(_pages(spark, ROWS), f"file://{tmp_path}/a")
    (path,) = [x for x in (tmp_path / "a").iterdir() if x.name.endswith(".gz")]
    data, ids, refers, kinds = gzip.decompress(path.read_bytes()), {}, [], collections.Counter()
    while data:
        headers, _ = warc.parse(data[: (end := data.index(b"\r\n\r\n") + 4) + int(re.search(rb"Content-Length: (\d+)", data[:end])[1]) + 4])
        block = data[end : end + int(headers["content-length"])]
        kinds[headers["warc-type"]] += 1
        if headers["warc-type"] != "warcinfo":
            assert headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            assert headers["warc-record-id"] not in ids and "\n" not in headers.get("warc-target-uri", "")
            ids[headers["warc-record-id"]] = headers["warc-type"]
            if "warc-refers-to" in headers:
                refers.append(headers["warc-refers-to"])
        data = data[end + len(block) + 4 :]
    assert kinds["warcinfo"] == 1 and refers and all(ids[x] == "response" for x in refers)


def test_archive_faults(spark, tmp_path):
    folder = warc.write_archives(_pages(spark, []), f"file://{tmp_path}/empty")
    assert warc.read_archives(spark, folder).count() == 0
    with pytest.raises(FileExistsError):
        warc.write_archives(_pages(spark, ROWS), folder)
    folder = warc.write_archives(_pages(spark, ROWS), f"file://{tmp_path}/torn")
    (path,) = [x for x in (tmp_path / "torn").iterdir() if x.name.endswith(".gz")]
    path.write_bytes(path.read_bytes()[:-30])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, folder).collect()
    got = warc.read_archives(spark, warc.write_archives(_pages(spark, ROWS), f"file://{tmp_path}/whole"), with_payload=True)
    assert {(x["page_id"], bytes(x["payload"])) for x in got.where("record_type = 'response' and page_id in (3, 10, 1)").collect()} == {(3, LONG.encode()), (10, b""), (1, b"y" * 99)}


# --- audit


def _plain_audit(rows, k=50, least=30):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows, term by term."""
    docs, n = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs.update((lang or "", w) for w in set(words))
        n[lang or "", source or ""].update(words)
    out = []
    for lang in {x for x, _ in n}:
        kept = [w for (x, w), c in docs.items() if x == lang and c >= least]
        groups = {s: {w: c[w] for w in kept} for (x, s), c in n.items() if x == lang}
        whole = {w: sum(g[w] for g in groups.values()) for w in kept}
        p = {s: {w: 1 + int(Fraction(10**9 * (c + 5), sum(g.values()) + 5 * len(kept))) for w, c in g.items()} for s, g in [*groups.items(), (None, whole)]}
        for s, g in groups.items():
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in groups if o != s]
            terms = [(p[s][w] - p[None][w], w) for w in kept if g[w] and p[s][w] > p[None][w]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, k)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ranked[:top], 1)]
    return sorted(out, key=repr)


def test_op12(spark):
    assert _run(spark, "op12_source_divergence") == _plain_audit([(x["lang"], x["source"], x["text"]) for x in _table("documents")])


def _words(seed, n, most):
    return " ".join(f"w{chr(97 + (seed * 31 + i * i * 7) % most % 26)}{'ÄßЯ'[(seed + i) % 3]}{chr(97 + (seed + i * 5) % most // 26)}" for i in range(n))


ODD = [("x", f"s{k % 7}", _words(k, 40 + k % 50, 60)) for k in range(160)] + [
    (None, None, None), ("x", None, ""), ("x", "only", "_123 ..."), ("", "s1", "İ Ǆ ÀB c\U0001f600d a\x00b"), (None, "s1", "İ Ǆ ÀB c\U0001f600d"), ("y", "alone", "one two"), ("y", "alone", "one two"),
    *[("z", f"t{k % 2}", "same words in all") for k in range(5)], ("x", "s1", "WA wa Wa " * 3000), ("x", "s2", "q" * 5000 + " " + "ж" * 3000),
]


@pytest.mark.parametrize("k,least", [(50, 30), (3, 2), (1, 1), (50, 100_000)])
def test_audit_of_odd_rows(spark, k, least):
    docs = spark.createDataFrame(ODD, "lang string, source string, text string").select("*", *[F.lit("other").alias(c) for c in ("n", "term", "docs")]).repartition(4)
    got = sorted((tuple(x) for x in divergence.audit(docs, k, least).collect()), key=repr)
    assert got == _plain_audit(ODD, k, least)


def test_audit_in_small_steps(spark, monkeypatch):
    """Tiles of few groups, lists over batches, short slices, many buckets and rounds."""
    for name, value in (("TILE", 3), ("PAIRS", 20), ("SLICE", 50), ("HELD", 100), ("EXACT", 2)):
        monkeypatch.setattr(divergence, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.createDataFrame(ODD, "lang string, source string, text string").repartition(4)
        for k in (2, 50):
            assert sorted((tuple(x) for x in divergence.audit(docs, k, 2).collect()), key=repr) == _plain_audit(ODD, k, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_probability_of_large_counts(spark):
    rows = [(0, 1, 1), (10**14, 10**14, 1), (123_456_789_012, 987_654_321_098_765, 40_000_000), (7, 10**15, 10**8)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.probability(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [x[0] for x in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in rows]


# --- trie


def _plain_trie(rows):
    """The nodes of (conv_id, turn, role, text) rows, prefix by prefix."""
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20) * (1 if c > 0 else -1)
        built[c] = tuple(said.get(family, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        worth = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += worth
    return sorted(
        (
            (min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path], leaves[path], saved[path],
             hashlib.sha256(",".join(str(c) for c in sorted(who) if built[c] == path).encode()).hexdigest())
            for path, who in members.items()
        ), key=repr,
    )


def test_op13(spark):
    assert _run(spark, "op13_prefix_trie") == _plain_trie([(x["conv_id"], x["turn"], x["role"], x["text"]) for x in _table("conversations")])


def _chats():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if c % 3 else t * c % 5}  of x") for c in range(-45, 70) if c % 11 for t in range((c * 7) % 9)]
    rows += [(c, None, None, None) for c in (5, 5, 26, 300)] + [(7, 0, "user", ""), (7, 0, None, "z"), (None, 0, "user", "x"), (2, 2, "user", "turn 2"), (2, 2, "user", "turn 2"), (88, 0, "a", "b" * 70 + "c"), (88, 0, "a", "b" * 70 + "a"), (88, 0, "a" * 70, "")]
    rows += [(1000 + k, t, "user", f"deep {t if t < 3 * k else -k}") for k in range(12) for t in range(40)]
    rows += [(c, t, "user", "copy") for c in (2001, 2003, 2017, 1999, 2000) for t in range(6)]
    return rows


def test_trie_of_odd_rows(spark):
    rows = _chats()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("other").alias(c) for c in ("conv", "depth", "words", "digest")]).repartition(5)
    got = prefix_trie.prefix_trie(turns)
    assert got.columns == [x.split()[0] for x in prefix_trie.NODES.split(", ")]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == _plain_trie(rows)


def test_trie_in_small_pieces(spark, monkeypatch):
    """Conversations longer than a piece; ids and batches that break within a node."""
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = _chats()
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert sorted((tuple(x) for x in prefix_trie.prefix_trie(turns).collect()), key=repr) == _plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_trie_of_one_long_conversation(spark):
    """A conversation that lies over all range partitions has its turns numbered right."""
    rows = [(4, k, "user", f"t{k}") for k in range(5000)] + [(9, 0, "user", "t0")]
    numbered = prefix_trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    assert sorted(x["pos"] for x in numbered.where("conv = 4").collect()) == list(range(1, 5001))


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    for rows in ([], [(None, 0, "user", "x")], [(25, 0, "user", "x")], [(0, 0, "user", "x"), (1, 0, "user", "x")]):
        assert sorted((tuple(x) for x in prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=repr) == _plain_trie(rows)


def test_sql_of_the_new_queries():
    assert {"op11_warc", "op12_source_divergence", "op13_prefix_trie"} <= set(queries.ORACLES)


def test_slices_keep_terms_whole(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 5)
    for text in ("", "abc", "aaaaaaaaaaaa b", "one two, three_four\n", "é" * 12 + " x", "a b c d e f g h", "abcd éfgh ijkl"):
        assert [w for x in divergence._slices(text) for w in divergence.terms_of(x)] == divergence.terms_of(text)
        assert "".join(divergence._slices(text)) == text


def test_possible_ids_of_many_tasks(spark):
    """None that is there is failed, few others pass, and no group of the aggregation has a
    row of every task."""
    ids = spark.range(0, 30_000, 3, numPartitions=500).withColumnRenamed("id", "k")
    maybe = shared.possible_ids(ids, "k", bits=1 << 16)
    got = {x["id"]: x["m"] for x in spark.range(30_000).select("id", maybe("id").alias("m")).collect()}
    assert all(got[k] for k in range(0, 30_000, 3)) and sum(got[k] for k in range(30_000) if k % 3) < 0.25 * 20_000
    none = shared.possible_ids(ids.limit(0), "k")
    assert spark.range(5).where(none("id")).count() == 0


def test_one_copy_of_a_text_for_many_stretches(spark, monkeypatch):
    """A document that 10,000 others repeat other parts of is sent to Python a few times;
    what is cut is the same however the stretches are grouped."""
    asked = spark.range(10_000).select(F.lit(7).cast("long").alias("rep_doc"), (F.col("id") * 3).alias("low"), (F.col("id") * 3 + 60).alias("high"))
    rows = lines._grouped(asked, 50).collect()
    assert len(rows) <= 160 * 10_000 // lines.CUT_WORDS + 1 and sum(len(x["cuts"]) for x in rows) == 10_000
    words = [f"w{k * k % 911}x{k}" for k in range(700)]
    texts = [(0, " ".join(words))] + [(k, "a b " * k + "\n".join(words[k * 9 : k * 9 + 55 + k]) + f" end{k}") for k in range(1, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, lines.remove_repeated_passages(docs).select("doc_id", "text", "removed_words").collect()))
    monkeypatch.setattr(lines, "CUT_WORDS", 100)
    assert sorted(map(tuple, lines.remove_repeated_passages(docs).select("doc_id", "text", "removed_words").collect())) == want and sum(x[2] for x in want) > 1000
