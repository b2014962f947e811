"""Operators of the training-data subpackage against brute force, on small tables
with nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tramline.llm import bpe, bpe_automaton, chat, fingerprint, forest, jaccard, language, lines, packing, quality, token_files
from tramline.llm.queries import tokenizer_path
from tramline.llm.shared import connected_components
from tramline.llm.units import library_tokenizer, library_units

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, start long, piece string"


def _docs():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    out = [(0, None), (1, ""), (2, "one two"), (3, " \t\n"), (4, "a" * 5000), (5, "odd  space\tand\r\n<|endoftext|> é́ \x1c end ")]
    base = [[r.choice(words) for _ in range(r.randint(4, 90))] for _ in range(25)]
    for k, ws in enumerate(base):
        out.append((10 + 3 * k, " ".join(ws)))
        if k % 2:
            out.append((11 + 3 * k, " ".join(ws)))
        if k % 3 == 0:
            copy = list(ws)
            copy[len(ws) // 2] = "changed"
            out.append((12 + 3 * k, " ".join(copy).upper()))
    out += [(900, " ".join(r.choice(words) for _ in range(9000))), (2, "one two"), (None, "no id here at all"), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in _docs()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, empty):
    tok = library_tokenizer(BYTE)
    want = collections.Counter()
    for i, t in _docs():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(x) for x in bpe.digest_documents(docs, BYTE).collect()) == want
    back = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE).collect()
    assert sorted(((x[0], x[1]) for x in back), key=str) == sorted(((i, t or "") for i, t in _docs()), key=str)
    assert bpe.digest_documents(empty, BYTE).count() == 0


def test_byte_automaton(monkeypatch):
    """Words go by transitions of the table, compiled once, and a table that starts again
    gives the same tokens."""
    r = random.Random(4)
    words = [bytes(r.choice(b"abcdefghi \xc3\xa9 tnre") for _ in range(r.randint(1, 30))) for _ in range(400)] + [b"a" * 3000, b"ab" * 700]
    tok = library_tokenizer(BYTE).model
    letters = {b: c for c, b in bpe_automaton.byte_letters().items()}
    want = [[x.id for x in tok.tokenize("".join(letters[b] for b in w))] for w in words]
    machine = bpe_automaton.BpeAutomaton(BYTE)
    assert machine.encode_words(words) == want
    states, held, compiled = len(machine.states), machine.held, []
    usual = machine._compile
    monkeypatch.setattr(machine, "_compile", lambda keys: compiled.append(len(keys)) or usual(keys))
    assert machine.encode_words(words) == want and not compiled and (len(machine.states), machine.held) == (states, held)
    # by hand: one transition at a time from the first state
    for w, ids in zip(words[:50], want):
        state = np.zeros(1, dtype=np.int32)
        for byte in w:
            state = machine._step(state, np.array([byte]))
        assert machine.last[state[0]] == ids[-1]
    monkeypatch.setattr(bpe_automaton, "MOST_STATES", 60)
    machine = bpe_automaton.BpeAutomaton(BYTE)
    assert machine.encode_words(words) == want and len(machine.states) < states


def test_units_equal_the_library():
    r = random.Random(1)
    letters = list("aab  \n.,'sétÀ019 　") + ["<|endoftext|>", "the", " tion", "\r\n", "́", "İ", "ſ"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(600)]
    for path, spaced in ((BYTE, True), (WORD, False)):
        tok = library_tokenizer(path)
        for text, values in zip(texts, library_units(path, spaced).texts(texts)):
            assert np.frombuffer(b"".join(values), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_token_files(docs, empty, tmp_path):
    manifest, folder = token_files.write_token_files(docs, BYTE, 2, f"file://{tmp_path}/t")
    got = sorted((tuple(x) for x in token_files.read_token_files(manifest, folder).collect()), key=lambda x: x[1])
    tok, at, want = library_tokenizer(BYTE), 0, []
    # null ids come first, in an order of their own
    assert sum(x[0] is None for x in got[:2]) == 2 and got[0][1] == 0
    for i, t in sorted((x for x in _docs() if x[0] is None), key=lambda x: -len(x[1] or "") if got[0][2] > 1 else len(x[1] or "")) + sorted((x for x in _docs() if x[0] is not None), key=lambda x: x[0]):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    manifest, folder = token_files.write_token_files(empty, BYTE, 2)
    assert token_files.read_token_files(manifest, folder).count() == 0
    for values in ([], [0], [5, 5, 9], sorted(random.Random(3).choices(range(10**7), k=3000))):
        index = token_files.EliasFano.build(np.array(values, dtype=np.int64))
        assert [index.select(k) for k in range(len(values))] == values


def test_packing(docs, empty):
    got = [x.asDict() for x in packing.pack_documents(docs, WORD).collect()]
    tok = library_tokenizer(WORD)
    assert sum(x["length"] for x in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in _docs())
    bins = collections.defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, WORD).count() == 0
    r = random.Random(2)
    for rule in ("norm", "dot"):
        counts = dict(collections.Counter(r.randint(1, 100) for _ in range(2000)))
        cap = packing.Capacity(100, 5, 6000, rule=rule)
        counts = {k: n for k, n in counts.items() if k * k <= 6000}
        plan = packing.plan_bins(counts, cap)
        used = collections.Counter()
        for content, n in plan:
            assert sum(a * k for a, k in content) <= 100 and sum(k for _, k in content) <= 5 and sum(a * a * k for a, k in content) <= 6000
            for a, k in content:
                used[a] += k * n
        assert used == counts and sum(n for _, n in plan) <= 1.15 * max(sum(counts.values()) / 5, sum(a * n for a, n in counts.items()) / 100, sum(a * a * n for a, n in counts.items()) / 6000) + 1


def test_fingerprint(spark, docs, empty):
    got = sorted((x.asDict() for x in fingerprint.edited_fingerprints(docs.where("doc_id <> 2 or doc_id is null")).where("doc_id is not null").collect()), key=lambda x: x["doc_id"])
    rows = sorted(((i, t or "") for i, t in _docs() if i is not None and i != 2), key=lambda x: x[0])
    nexts = [t for _, t in rows[1:]]
    for x, (i, t), n in zip(got, rows, nexts):
        half = len(t) // 2
        assert x["doc_id"] == i and x["n_chars"] == len(t)
        assert x["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
    by_text = collections.defaultdict(set)
    for x, (_, t) in zip(got, rows):
        by_text[t].add(x["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.edited_fingerprints(empty).count() == 0
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(1, "abcd", "", 0, "")], SCHEMA)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    # counts by hand
    data = b"the quick brown fox"
    assert fingerprint.triplet_counts([data]).sum() == 6 * (len(data) - 4)


def _brute_jaccard(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_jaccard(docs, empty):
    got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.join_documents(docs).collect())
    assert got == _brute_jaccard(_docs())
    assert jaccard.join_documents(empty).count() == 0


def test_jaccard_near_copies(spark):
    """A large group whose members are linked in chains and stars."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(r.randint(0, 5)):
            ws[r.randrange(len(ws))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter(tuple(x) for x in got) == _brute_jaccard(rows)


def test_jaccard_rows_of_one_id(spark):
    """Different texts with a null id or the same id are documents of their own, and words
    that collide under polynomial hashes are not equal."""
    r = random.Random(10)
    rows = []
    for k in range(6):
        ws = [f"a{k}x{j}" for j in range(60)]
        rows += [(None if k % 2 else 77, " ".join(ws)), (None if k % 3 else 78, " ".join([*ws[:-1], "other"]))]
    bits = ["ab"[bin(i).count("1") % 2] for i in range(2048)]
    word, opposite = "".join(bits), "".join("ba"[x == "b"] for x in bits)
    rows += [(500, f"x {word} y z w"), (501, f"x {opposite} y z w"), (502, None), (None, None), (77, rows[0][1])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter(tuple(x) for x in jaccard.join_documents(df).collect())
    assert got == _brute_jaccard(rows)
    kept = collections.Counter(tuple(x) for x in jaccard.keep_one_of_each(df).collect())
    # one row a component: six pairs, the two words, and both null texts
    assert sum(kept.values()) == 6 + 2 + 2 and kept[(None, None)] == kept[(502, None)] == 1


def test_jaccard_blocks_of_a_long_list(spark, monkeypatch):
    """A list longer than a block is compared block by block, and lists of one component
    are dealt to several tasks."""
    r = random.Random(11)
    shared = [f"s{k}" for k in range(40)]
    rows = []
    for i in range(120):
        own = [f"o{i // 3}_{k}" for k in range(14)]
        for _ in range(r.randint(0, 2)):
            own[r.randrange(len(own))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(shared + own)))
    usual = jaccard._open_pairs
    monkeypatch.setattr(jaccard, "_open_pairs", lambda *a: usual(*a, block=7, together=30))
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter(tuple(x) for x in got) == _brute_jaccard(rows)


def test_lines(spark, empty):
    r = random.Random(4)

    def prose(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + ("." if k % 7 == 6 else "") for k in range(n))

    passage = prose(80)
    texts = [f"{prose(60)}\n{passage}\n{prose(30)}" for _ in range(6)] + [prose(200), None, "", "short line.", "short line."]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (20, texts[6])]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, removed_words long").repartition(3)
    got = {x["doc_id"]: x for x in lines.remove_repeated_passages(df).collect() if x["doc_id"] is not None}
    assert len(got) == len(rows) - 1
    first = min(i for i in range(6) if passage in got[i]["text"])
    holders = [i for i in range(6) if passage in (got[i]["text"] or "")]
    assert len(holders) <= 1 and (not holders or holders == [first])
    assert got[6]["text"] == texts[6] and got[20]["text"] == "" and got[20]["removed_words"] == 200
    assert got[7]["text"] is None and got[8]["text"] == "" and got[9]["text"] == got[10]["text"] == "short line."
    for i in range(1, 6):
        head, tail = texts[i].split("\n")[0], texts[i].split("\n")[2]
        assert head in got[i]["text"] and tail in got[i]["text"]
    assert lines.remove_repeated_passages(empty).count() == 0


def _brute_words(texts, least):
    """Words of every document without those of all runs of ``least`` words or more that
    an earlier document has."""
    words = [t.split() for t in texts]
    places = collections.defaultdict(list)
    for d, x in enumerate(words):
        for a in range(len(x) - least + 1):
            places[tuple(x[a : a + least])].append((d, a))
    gone = {(d, k) for found in places.values() for d, a in found if d != found[0][0] for k in range(a, a + least)}
    return [[y for k, y in enumerate(x) if (d, k) not in gone] for d, x in enumerate(words)]


def _without_repeats(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lines.remove_repeated_passages(df).orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        left, at = [], 0
        for span in row["removed"]:
            left.append(text[at : span["start"]])
            at = span["end"]
        assert "".join([*left, text[at:]]) == row["text"] and len(text.split()) - len(row["text"].split()) == row["removed_words"]
    return [x["text"] for x in rows]


def test_lines_inside_longer_lines_and_over_short_lines(spark):
    r = random.Random(6)

    def sentences(n, words, end):
        return "".join(" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(r.randint(*words))) + end for _ in range(n))

    texts, passages = [], []
    for _ in range(12):
        inside, over = sentences(5, (11, 14), ". "), sentences(8, (7, 9), "\n")
        passages.append((inside, over))
        for _ in range(3):
            texts.append(sentences(4, (6, 14), ". ") + inside + sentences(4, (6, 14), ". ") + "\n" + sentences(3, (6, 9), "\n") + over + sentences(3, (6, 9), "\n"))
    got = _without_repeats(spark, texts)
    assert [x.split() for x in got] == _brute_words(texts, 50)
    assert all((p in x) == (k % 3 == 0) for k, x in enumerate(got) for p in passages[k // 3])


@pytest.mark.parametrize("size", [51, 80, 120, 200])
def test_recall_of_lines(spark, size):
    """Passages in longer lines, of lines of their own and without any full stop, between
    text that differs: at least nine in ten copies go, and nothing else does."""
    r = random.Random(size)

    def word():
        return "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))

    def text(n, stops, ends):
        out = [word() + ("." if stops and r.random() < stops else "") for _ in range(n)]
        return "".join(x + ("\n" if ends and r.random() < ends else " ") for x in out)

    kinds = {"inside": (0.1, 0.0), "by line": (0.0, 0.12), "unpunctuated": (0.0, 0.0)}
    texts, planted = [], []
    for stops, ends in kinds.values():
        for _ in range(20):
            passage = text(size, stops, ends)
            planted.append(len(texts))
            texts += [text(r.randint(20, 90), stops, ends) + passage + text(r.randint(20, 90), stops, ends) for _ in range(3)]
    got = _without_repeats(spark, texts)
    want = _brute_words(texts, 50)
    for k in range(3):
        copies = [d + c for d in planted[20 * k : 20 * k + 20] for c in (1, 2)]
        assert sum(got[d].split() == want[d] for d in copies) >= 0.9 * len(copies), list(kinds)[k]
        assert all(got[d] == texts[d] for d in planted[20 * k : 20 * k + 20])


def test_seeds_do_not_depend_on_what_stands_around():
    assert all(len(x) == 0 for texts in ([], [b""], [b"", b" \n"], [b"one two"]) for x in lines.seeds(texts))
    r = random.Random(3)
    words = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(400)]
    alone = " ".join(words).encode()
    value, text, first, size, head = lines.seeds([b"x y z", alone, b"", " ".join(words[:200] + words[:200]).encode()])
    assert set(text.tolist()) == {1, 3} and (size >= lines.SEED_WORDS).all()
    one = {(v, f) for v, t, f in zip(value.tolist(), text.tolist(), first.tolist()) if t == 1}
    assert one == {(v, f) for v, f in zip(lines.seeds([alone])[0].tolist(), lines.seeds([alone])[2].tolist())}
    # the second half of the last text repeats most of the first, and only the first is a head
    half = [(v, f, h) for v, t, f, h in zip(value.tolist(), text.tolist(), first.tolist(), head.tolist()) if t == 3]
    seen = {v for v, f, h in half if h and f < 180}
    assert sum(v in seen and not h for v, f, h in half) > 0.8 * len(seen)


def test_lines_of_one_long_sentence(spark):
    r = random.Random(7)

    def words(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n))

    licence = words(60)
    texts = ["\n".join([*(words(7) for _ in range(5)), licence, *(words(7) for _ in range(5))]) for _ in range(9)]
    assert _without_repeats(spark, texts) == [texts[0], *(t.replace(licence + "\n", "") for t in texts[1:])]


def test_lines_with_an_earlier_excerpt(spark):
    r = random.Random(8)

    def sentence(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n)) + ".\n"

    texts, want = [[], [], []], [[], [], []]
    for _ in range(8):
        passage = [sentence(12) for _ in range(5)]
        # three lines of 36 words, then the whole passage twice
        for k, part in enumerate(("".join(passage[1:4]), "".join(passage), "".join(passage))):
            around = sentence(9), sentence(9)
            texts[k].append(around[0] + part + around[1])
            want[k].append(around[0] + ("" if k == 2 else part) + around[1])
    assert _without_repeats(spark, sum(texts, [])) == sum(want, [])


def _planted(seed, n, dims, pairs):
    """Random vectors, of which the last ``pairs`` are near another: cosine 0.9 and more."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of, cosine = r.integers(0, n - pairs, pairs), r.uniform(0.905, 0.995, pairs)
    side = r.standard_normal((pairs, dims))
    side -= (side * x[of]).sum(axis=1, keepdims=True) * x[of]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[n - pairs :] = cosine[:, None] * x[of] + np.sqrt(1 - cosine**2)[:, None] * side
    return x.astype(np.float32)


def _recall(spark, x, **options):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    got = forest.near_duplicates(df, **options).toPandas().set_index("vec_id").sort_index()
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = np.concatenate([((u[k : k + 2000] @ u.T) >= 0.9).sum(axis=1) - 1 for k in range(0, len(u), 2000)])
    assert (got["n_links"].to_numpy() <= links).all()  # none that is not there
    assert (got["kept"] == (got["component_id"] == got.index)).all()
    return got["n_links"].sum() / links.sum(), links.sum()


def test_forest_finds_planted_links_with_its_own_parameters(spark):
    """13,000 vectors, trees of four levels: depth 3 and more."""
    assert math.ceil(math.log2(13_000 / 1500)) >= 3
    recall, links = _recall(spark, _planted(1, 13_000, 64, 3000))
    assert links >= 6000 and recall >= 0.95, recall


def test_forest_splits_large_leaves_again(spark):
    """Where the sample allows two levels only, the leaves go on on executors."""
    x = _planted(2, 6000, 32, 1500)
    recall, links = _recall(spark, x, leaf_size=100, sample_size=100, block=400)
    assert links >= 3000 and recall >= 0.93, recall


def test_forest(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    x = np.concatenate([centres[r.integers(0, 40, 300)] + 0.25 * r.standard_normal((300, 16)), r.standard_normal((100, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] + [1.0] * 15, 0), (1004, x[0].tolist(), 2), (1005, [1.0, 2.0], 0), (1006, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long")
    # other dimensions among them, each with links of its own
    rows += [(2000 + k, [1.0, 0.1 * (k // 4)], 0) for k in range(8)] + [(2100, [0.0, 1.0, 0.0], 0), (2101, [0.0, 2.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long")
    got = {y["vec_id"]: y for y in forest.near_duplicates(df, leaf_size=60, block=50).collect()}
    ids = [*range(len(x)), 1004]
    u = np.concatenate([x, x[:1]]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.9
    links = near.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    # components by brute force: as fine where all of a vector's links were found
    parent = list(range(len(ids)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in np.argwhere(np.triu(near, 1)):
        u, v = find(a), find(b)
        parent[max(u, v)] = min(u, v)
    want = np.array([ids[find(k)] for k in range(len(ids))])
    have = np.array([got[i]["component_id"] for i in ids])
    assert (have == want).mean() >= 0.97 and all(find(ids.index(c)) == find(k) for k, c in enumerate(have))
    assert got[1004]["component_id"] == got[0]["component_id"] <= 0 and not got[1004]["kept"]
    for i in (1000, 1001, 1002, 1003, 1006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[1005]["n_links"] == 0 and all((got[2000 + k]["n_links"], got[2000 + k]["component_id"]) == (7, 2000) for k in range(8))
    assert got[2100]["n_links"] == got[2101]["n_links"] == 1 and got[2101]["component_id"] == 2100
    # every link is counted once, whatever leaves a pair shares
    whole = {y["vec_id"]: y for y in forest.near_duplicates(df, leaf_size=10**6).collect()}
    assert [whole[i]["n_links"] for i in ids] == links.tolist() and [whole[i]["component_id"] for i in ids] == want.tolist()
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (200, 100)]
    got = {x[0]: x[1] for x in connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def test_chat(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "<|im_end|>\\<\\|x"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
        {"instruction": "do", "input": "this", "output": "done"}, {"prompt": "p", "completion": ""},
        {"turns": [{"turn": 2, "role": "assistant", "text": "b"}, {"turn": 1, "role": "user", "text": "a"}]}, {"other": 1},
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(records)] + [(6, "not json"), (7, None)]
    got = {x["id"]: x for x in chat.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert [got[i]["layout"] for i in range(8)] == ["messages", "from-value", "instruction", "prompt-completion", "turns", None, None, None]
    assert chat.parse(got[0]["formatted"]) == [("user", "hi"), ("assistant", "<|im_end|>\\<\\|x")]
    assert chat.parse(got[2]["formatted"]) == [("user", "do\n\nthis"), ("assistant", "done")]
    assert chat.parse(got[4]["formatted"]) == [("user", "a"), ("assistant", "b")]
    assert chat.schema_fingerprint({"a"}) != chat.schema_fingerprint({"b"}) and got[5]["fingerprint"]
    r = random.Random(8)
    for _ in range(300):
        turns = [("".join(r.choice("a\\\n<|>") for _ in range(4)), "".join(r.choice("a\\<|>\nim_end") for _ in range(12))) for _ in range(3)]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
    table = spark.createDataFrame([(1, 1, "assistant", "y", 0), (1, 0, "user", None, 0), (None, None, None, "z", 0), (1, 1, "assistant", "y", 0)], "conv_id long, turn long, role string, text string, id long")
    got = {x["conv_id"]: x for x in chat.digest(chat.format_turn_rows(table)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[None]["n_turns"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\ny\nassistant\ny\n").hexdigest()
    # each conversation's own nested record selects the mapping
    made = {x["id"]: x for x in chat.format_turn_rows(table).collect()}
    paths = chat.field_paths({"rows": [{"turn": 0, "role": "user", "text": ""}]})
    assert made[1]["fingerprint"] == chat.schema_fingerprint(paths) and made[1]["layout"] == "turn-rows"
    assert made[None]["fingerprint"] == chat.schema_fingerprint(paths - {"rows[].turn"})
    other = chat.Mapping("shouted", ("rows[].turn",), items="rows", text="text", order="turn", roles={"user": "USER"})
    made = {x["id"]: x for x in chat.format_turn_rows(table, mappings=(other,)).collect()}
    assert chat.parse(made[1]["formatted"])[0] == ("USER", "") and made[None]["formatted"] is None
    assert chat.format_turn_rows(table.limit(0)).count() == 0


def test_language(spark, docs, empty):
    r = random.Random(6)
    made = []
    for i in range(300):
        lang, letters = (("aa", "etaoin"), ("bb", "wçyüzk"))[i % 2]
        made.append((i, " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(20)), lang))
    df = spark.createDataFrame(made + [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, made[0][1] + " " + made[1][1], None), (904, "слово", None)], "doc_id long, text string, lang string")
    model = language.train(df.where("doc_id % 5 <> 0"))
    got = {x["doc_id"]: x for x in language.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in made if i % 5 == 0)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[904]["lang_pred"] in ("aa", "bb")
    assert [(s["first"], s["last"], s["lang"]) for s in got[903]["spans"]] == [(0, 20, "aa"), (20, 40, "bb")]
    assert language.train(empty) is None and language.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    # the best path of one text, by trying all
    scores = np.random.default_rng(1).standard_normal((6, 3)) * 3
    labels = language.viterbi(np.arange(6), np.array([0]), np.array([6]), scores, 2.0)

    def worth(path):
        return sum(scores[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    import itertools

    assert math.isclose(worth(labels.tolist()), max(worth(p) for p in itertools.product(range(3), repeat=6)))
    # many texts at once, most of one language: as the steps alone label them
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 40, 300)
    starts = np.cumsum(lengths) - lengths
    words = rng.permutation(np.arange(lengths.sum()) % 900)
    scores = rng.standard_normal((900, 4)) * 3
    for lean in (0.0, 1.0, 4.0):
        tilted = scores + lean * np.eye(4)[1]
        assert (language.labels_of(words, starts, lengths, tilted, 9.0) == language.viterbi(words, starts, lengths, tilted, 9.0)).all()
    assert len(language.labels_of(words[:0], starts[:0], lengths[:0], scores, 9.0)) == 0


def test_language_steps(monkeypatch):
    # passages of two to four languages: labelled as the steps alone label them, which take
    # no more of them than the words in doubt need
    rng = np.random.default_rng(3)
    scores = rng.standard_normal((400, 4)) + 4 * np.eye(4)[np.arange(400) % 4]
    passages = [[(0, 2000), (1, 2000)], [(2, 3000)], [(3, 900), (0, 30), (3, 900)], [(1, 500), (2, 500), (3, 500), (1, 2)], [], [(0, 1)]]
    texts = [np.concatenate([4 * rng.integers(0, 100, n) + k for k, n in x] or [np.zeros(0, dtype=np.int64)]) for x in passages]
    lengths = np.array([len(x) for x in texts])
    words, starts = np.concatenate(texts), np.cumsum(lengths) - lengths
    want, longest = language.viterbi(words, starts, lengths, scores, 12.0), [0]
    steps = language.viterbi

    def counted(words, starts, lengths, *more):
        longest.append(int(lengths.max()))
        return steps(words, starts, lengths, *more)

    monkeypatch.setattr(language, "viterbi", counted)
    assert (language.labels_of(words, starts, lengths, scores, 12.0) == want).all() and len(set(want.tolist())) == 4
    assert max(longest) < 256  # the longest text has 4000
    # passages of little evidence, and switches that cost little or nothing
    for spread, penalty in itertools.product((0.3, 2.0), (0.0, 0.5, 9.0, 40.0)):
        lengths = rng.integers(0, 700, 20)
        words, starts = rng.integers(0, 400, lengths.sum()), np.cumsum(lengths) - lengths
        weak = rng.standard_normal((400, 5)) * spread
        assert (language.labels_of(words, starts, lengths, weak, penalty) == steps(words, starts, lengths, weak, penalty)).all()


def test_language_words():
    # words by any white space, none of them empty, and their scores as for each alone
    texts = [" etaoin  natoe\n", "", "\n", "wçyüzk etaoin", "a\tb\u2003c \u00a0d", "слово naïve İΣ ΣΑΣ 12 x^$y"]
    model = language.LanguageModel(["aa", "bb", "cc"], np.random.default_rng(4).standard_normal((3, language.BUCKETS)).astype(np.float32), np.zeros((3, len(language.SCRIPTS)), dtype=bool))
    model.scripts[:2, language.SCRIPTS.index("latin")] = True
    model.scripts[2, language.SCRIPTS.index("cyrillic")] = True
    labeller = language._Labeller(model)
    words, _, _, lengths = labeller.label(texts)
    apart = [w for t in texts for w in t.split()]
    assert lengths.tolist() == [len(t.split()) for t in texts] and len(words) == len(apart)
    for row, word in zip(words, apart):
        scores, letters, known = model.words([word.lower()])
        assert (labeller.scores[row] == scores[0].astype(np.float32)).all()
        assert labeller.letters[row].tolist() == [sum(map(str.isalpha, word.lower())), int(letters[0] * known[0])]
    many = [w.lower() for w in apart] * (2 * language.LOT // len(apart) + 1)
    scores, letters, known = model.words(many)
    assert (scores == np.tile(model.words(many[: len(apart)])[0], (len(many) // len(apart), 1))).all() and len(letters) == len(known) == len(many)
    assert [x.shape for x in model.words([])] == [(0, 3), (0,), (0,)]


def test_quality(spark, docs, empty):
    r = random.Random(7)
    good = ["river", "stone", "cloud", "light", "green", "paper", "house", "train"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join((r.choice("xyzq") * 3 + "!!") if bad and r.random() < 0.8 else r.choice(good) for _ in range(60))))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    df = spark.createDataFrame(rows + [(None, "river stone"), (1000, None)], "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame(labels + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x for x in quality.resample(df, model).collect()}
    # weights and keys from the texts, by hand
    texts = dict([*rows, (None, "river stone"), (1000, None)])
    raw, target = collections.Counter(), collections.Counter()
    sample = {i: good for i, good, _ in labels}
    halves = {x["doc_id"]: x["h"] % 2 for x in spark.range(400).select(F.col("id").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h")).collect()}
    for i, text in texts.items():
        grams = _buckets(text)
        raw.update(grams)
        if sample.get(i) and halves[i] == 0:
            target.update(grams)
    n_raw, n_target, added = sum(raw.values()), sum(target.values()), 5.0 * quality.BUCKETS

    def ratio(b):
        q = (raw[b] + 1) / (n_raw + quality.BUCKETS)
        return math.log((target[b] + added * q) / (n_target + added)) - math.log(q)

    keys = {}
    for i, text in texts.items():
        grams = _buckets(text)
        weight = 100 * sum(map(ratio, grams)) / (len(grams) + 50)
        h = xxhash.xxh3_64_intdigest(f"7 {-(1 << 63) if i is None else i} {xxhash.xxh3_64_hexdigest((text or '').encode())}")
        keys[i] = weight - math.log(-math.log((h + 0.5) / 2**64))
        assert math.isclose(got[i]["log_weight"], weight, abs_tol=1e-9) and math.isclose(got[i]["gumbel_key"], keys[i], abs_tol=1e-9)
    k = sum(x["log_weight"] >= model.boundary for x in got.values())
    want = set(sorted(keys, key=lambda i: -keys[i])[:k])
    assert {i for i in got if got[i]["selected"]} == want
    # the noise takes part, and most of what is drawn is good
    assert want != {i for i in got if got[i]["log_weight"] >= model.boundary}
    assert sum(i is not None and i < 400 and i % 4 != 0 for i in want) >= 0.95 * k
    none = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.boundary == -math.inf and quality.resample(df, none).where("not selected").count() == 0
    assert quality.resample(empty, none).count() == 0
    scored = quality.score(df, model.ratio)
    for k in (0, 1, 37, 402, 500):
        top = {x["doc_id"] for x in quality.gumbel_top_k(scored, k).collect()}
        assert top == set(sorted(keys, key=lambda i: -keys[i])[:k])
    # many rows, few of them seen by the driver, with ties
    many = spark.range(5000).select((F.col("id") % 700).cast("double").alias("v"))
    ordered = sorted((float(i % 700) for i in range(5000)), reverse=True)
    for k in (1, 8, 9, 2500, 5000):
        assert quality.kth_largest(many, k, "v", bins=8, few=20) == ordered[k - 1]
    assert quality.kth_largest(many, 5001, "v") == -math.inf


def _buckets(text):
    """n-gram buckets of a text, one by one."""
    h = [int.from_bytes(xxhash.xxh3_64_digest(t.encode()), "little") for t in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    low = (1 << 64) - 1
    pairs = [((a * 0x9E3779B97F4A7C15 & low) ^ (b >> 7)) * 0xD6E8FEB86659FD93 & low for a, b in zip(h, h[1:])]
    return [x >> 48 for x in [*h, *pairs]]


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"
    assert sum(x["length"] for x in got) > 0 and all(x["offset"] + x["length"] <= 2048 for x in got)
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    odd = documents.limit(20).withColumn("_v0", F.lit(1)).unionByName(spark.createDataFrame([(None, None, None, None, None, 1)], documents.schema.simpleString()[7:-1].replace(":", " ") + ", _v0 int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns
