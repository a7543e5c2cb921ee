"""Text operators against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from tokenizers import Tokenizer, models

from litscore.llm.common import slices
from litscore.llm import counts, mixing, packing, simple8b
from litscore.llm.counts import Counter as PieceCounter
from litscore.llm.jaccard import bitmap, fitting_width, folded, shingle_sets, similar_groups, tree_join
from litscore.llm.quality import classify, fit_quality
from litscore.llm.shared import degrees, merged, shared_hashes
from litscore.llm.suffix import LENGTH, digest, refine, remove_repeats
from litscore.llm.tokens import CachedTokenizer, tokenizer_path
from litscore.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=120):
    """Texts with exact copies, near copies, shared passages, long and odd ones; ids in no order."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    def text(k):
        return " ".join(rng.choice(words) for _ in range(k))
    passage, base, rows = text(30), text(80), []
    for i in range(n):
        kind = i % 6
        own = text(rng.randint(1, 90))
        if kind == 1:
            own = f"{own}\n{passage} {text(5)}"
        elif kind == 2:
            own = rows[-1][1]
        elif kind == 3:
            near = base.split(" ")
            for _ in range(rng.randint(0, 6)):
                near[rng.randrange(len(near))] = rng.choice(words).upper()
            own = " ".join(near)
        rows.append((i * 7 % n, own))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  two"), (None, base), (None, None)]
    rows += [(1005, "ab " * 30_000), (1006, "ab " * 3_000), (1007, base), (1007, base), (1007, passage)]
    return rows


def brute_groups(rows):
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(fold))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = {r[0]: r[0] for r in rows if r[0] is not None}
    while True:
        before = dict(group)
        for i, a in enumerate(sets):
            for j in range(i):
                x, y = rows[i][0], rows[j][0]
                if x is None or y is None or not a or not sets[j]:
                    continue
                both = len(a & sets[j])
                if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                    group[x] = group[y] = min(group[x], group[y])
        if group == before:
            return Counter((r[0], len(s), group.get(r[0])) for r, s in zip(rows, sets))


def test_groups_equal_brute_force(documents):
    rows = corpus()
    got = similar_groups(documents(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)


def test_groups_of_split_cells(documents, monkeypatch):
    import litscore.llm.jaccard as jaccard

    monkeypatch.setattr(jaccard, "CELL_DOCS", 4)
    rows = corpus(5)
    got = similar_groups(documents(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)


def test_keys_are_rare_shingles(documents):
    """Pairs of near copies that all hold one notice: no key is a shingle of the notice."""
    rng = random.Random(8)
    text = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    notice, rows = text(40), []
    for i in range(30):
        own = text(60)
        rows += [(2 * i, " ".join(own + notice)), (2 * i + 1, " ".join([*own[:-1], "x", *notice]))]
    sets = shingle_sets(documents(rows)).collect()
    assert max(Counter(k for r in sets for k in r["keys"]).values()) == 2
    groups = {(r.doc_id, r.component_id) for r in similar_groups(documents(rows)).collect()}
    assert groups == {(i, i - i % 2) for i in range(60)}


def test_shared_hashes_are_counted(documents):
    """Every bucket is told how many documents hold a hash, whichever buckets these are in."""
    from litscore.llm.jaccard import Shingles
    from litscore.llm.shared import bucket_of

    docs = documents([(i, "a b c d e" if i < 9 else "f g h i j" if i < 11 else f"k{i}") for i in range(14)])
    dealt = docs.select(bucket_of(3), "doc_id", "text")
    plain, counted = (shared_hashes(dealt, 3, Shingles, "t", c).toArrow() for c in (False, True))
    degree = {}
    for origin in range(3):
        one, two = (t.filter(pa.compute.equal(t["origin"], origin)) for t in (plain, counted))
        assert merged(one).tolist() == merged(two).tolist()
        for h, d in zip(merged(two).tolist(), degrees(two).tolist()):
            assert degree.setdefault(h, d) == d
    assert sorted(degree.values()) == [2, 4]  # of two and of nine documents


def test_tree_join_equals_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 200, np.uint64)
    sets = []
    for _ in range(300):
        k = rng.integers(1, 200)
        own = base.copy() if k % 3 else rng.integers(0, 1 << 60, k, np.uint64)
        own[rng.random(len(own)) < rng.random() * 0.3] += np.uint64(rng.integers(1, 9))
        sets.append(np.unique(own))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    bits = [bitmap(s, fitting_width(len(s))) for s in sets]
    assert tree_join(sizes, sizes, bits, sets).tolist() == label
    loose = tree_join(sizes, sizes, bits)  # joins at least what is similar
    assert all(loose[i] == loose[j] for i, j in enumerate(label))
    wide = bitmap(base, 4096)
    assert (folded(wide, 256) == bitmap(base, 256)).all()


def test_repeats_equal_brute_force(documents):
    rows = corpus()
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - LENGTH + 1) if doc_id is not None else ():
            w = raw[k : k + LENGTH]
            first[w] = min(first.get(w, doc_id), doc_id)
    expected = Counter()
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - LENGTH + 1) if doc_id is not None else ():
            if first[raw[k : k + LENGTH]] < doc_id:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        expected[doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = digest(remove_repeats(documents(rows))).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected


def test_refinement_groups_equal_suffixes():
    rng = np.random.default_rng(4)
    strings = [bytes(rng.integers(97, 99, rng.integers(50, 90), np.uint8)) for _ in range(40)]
    strings += [s[:60].ljust(60, b"a") for s in strings[:20]] + [b"a" * 80, b"ab" * 40]
    data = np.frombuffer(b"".join(strings), np.uint8)
    at, bucket = refine(data, np.cumsum([0, *map(len, strings)]))
    raw, seen = data.tobytes(), {}
    for p, b in zip(at.tolist(), bucket.tolist()):
        assert seen.setdefault(raw[p : p + LENGTH], b) == b
    assert len(set(seen.values())) == len(seen)
    assert len(at) == sum(len(s) - LENGTH + 1 for s in strings)


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "B", "é", "é", " ", "  ", "   ", "\n", "\n\n", "\t", "  ", "　", "\x1c", "\x85", "'s", "'ll", "12",
             "!!", "<|endoftext|>", "<|start", "<|startoftext|>", "\U0001f600", "中文", "ΣΑΣ", "\r\n", "İ", "_", "​", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["", "x" * 50_000]


@pytest.mark.parametrize(("name", "drop"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_cached_ids_equal_the_library(name, drop):
    plain = Tokenizer.from_file(tokenizer_path(name))
    plain.encode_special_tokens = True
    texts = odd_texts()
    texts += [t for _, t in corpus()]
    cached, ids = CachedTokenizer(tokenizer_path(name), drop), []
    for first, last, data, ends in slices(pa.array(texts)):
        found, sizes = cached.encode(data, ends)
        ids += found.tolist()
        assert len(sizes) == last - first and sizes.sum() == len(found)
        for k in range(first, last):
            own = plain.encode(texts[k] or "", add_special_tokens=False).ids
            assert sizes[k - first] == len(own)
    assert [i for t in texts for i in plain.encode(t or "", add_special_tokens=False).ids] == ids


@pytest.mark.parametrize(("name", "drop"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_cached_ids_equal_the_plain_call_on_special_tokens(name, drop):
    plain = Tokenizer.from_file(tokenizer_path(name))
    texts = odd_texts() + ["a  <|endoftext|>  b <|endoftext|>", " <|", "<|endoftext|><|startoftext|> c", "x <|ENDOFTEXT|> y"]
    cached, ids, sizes = CachedTokenizer(tokenizer_path(name), drop, special=True), [], []
    for _, _, data, ends in slices(pa.array(texts)):
        found, own = cached.encode(data, ends)
        ids += found.tolist()
        sizes += own.tolist()
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes == [len(e) for e in expected] and ids == [i for e in expected for i in e]


def test_special_tokens_of_packed_and_written_texts(spark, documents):
    rows = [(1, "a  <|endoftext|>b"), (2, "c <|startoftext|> d"), (3, "e")]
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack(documents(rows), tokenizer_path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    name, path = tokenizer_path("word_bpe_49k.json"), scratch_path(spark, "test-special-ids")
    library = Tokenizer.from_file(name)
    simple8b.write_ids(documents(rows), path, name)
    got = {r.doc_id: r.ids_crc32 for r in simple8b.crc(simple8b.read_ids(spark, path)).collect()}
    assert got == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows}


@pytest.mark.parametrize("fallback", [False, True])
def test_piece_counts_equal_the_library(fallback):
    pieces = counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    pieces += [("éa", -5.0), ("aé", -5.0)]  # a tie
    head = [("<unk>", 0.0)] + ([(f"<0x{i:02X}>", 0.0) for i in range(256)] if fallback else [])
    library = Tokenizer(models.Unigram(head + pieces, 0, fallback))
    texts = odd_texts() + [t or "" for _, t in corpus()]
    n, scores = PieceCounter(pieces, fallback)(texts)
    expected = [len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for t in texts]
    assert n.tolist() == expected and scores[texts.index("")] == 0


def test_count_tokens_rows(documents):
    got = counts.count_tokens(documents(corpus()), tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(corpus()) and {r.n_tokens for r in got if r.doc_id in (1000, 1001)} == {0}


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 6000))
    ids = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) >> rng.integers(0, 64, n, np.uint64)
    words, runs = simple8b.encode(ids)
    assert (simple8b.decode(words) == ids).all()
    ends = [*runs[1:].tolist(), len(words)]
    for k, (a, b) in enumerate(zip(runs.tolist(), ends)):
        assert (simple8b.decode(words[a:b]) == ids[k * simple8b.RUN : (k + 1) * simple8b.RUN]).all()


def test_simple8b_extremes():
    top = (1 << 64) - 1
    for ids in ([], [0], [top], [0] * 200, [1 << 60, (1 << 60) - 1, top, 0, 0], [(1 << 53) - 1, (1 << 53), (1 << 54) - 1] * 3):
        assert simple8b.decode(simple8b.encode(np.array(ids, np.uint64))[0]).tolist() == ids


def test_token_file_round_trip(spark, documents):
    rows, path = corpus(), scratch_path(spark, "test-ids")
    name = tokenizer_path("word_bpe_49k.json")
    simple8b.write_ids(documents(rows), path, name)
    library = Tokenizer.from_file(name)
    library.encode_special_tokens = True
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    expected, start = Counter(), 0
    for doc_id, text in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        expected[doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    got = simple8b.crc(simple8b.read_ids(spark, path)).collect()
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected


def test_packing(documents):
    rows = corpus()
    name = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(name)
    library.encode_special_tokens = True
    expected = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 1024):
            own = np.array(ids[a : a + 1024], "<u4")
            expected[doc_id, a, len(own), zlib.crc32(own.tobytes()), len(ids)] += 1
    got = packing.pack(documents(rows), name).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for own in windows.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(windows) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1025, 3000)
    number, offset, n = packing.best_fit_decreasing(sizes)
    free, expected = [], []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [f for f in free if f >= sizes[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[i])
            expected.append(1024 - min(fits))
        else:
            free.append(1024 - sizes[i])
            expected.append(0)
    assert n == len(free) and [offset[i] for i in np.argsort(-sizes, kind="stable")] == expected


def mixed_rows():
    rng = random.Random(8)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "a", "a", "b", "ü", "Z", None, ""])
        rows.append((i, "w " * rng.randint(0, 400), source))
    return rows + [(3, None, "a"), (3, "x y", "a"), (None, "u v w", "b"), (900, "tiny source here", "zz")]


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high, total = 0.0, 1e12, sum(sizes.values())
    for _ in range(300):  # the level at which the capped shares add up
        level = (low + high) / 2
        if sum(min(3 * sizes[s], level * weight[s]) for s in names) < total:
            low = level
        else:
            high = level
    return {s: min(3 * sizes[s], low * weight[s]) for s in names}


def test_mixing(documents):
    rows = mixed_rows()
    df = documents(rows)
    got = mixing.taken_words(*mixing.mix_sources(df)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    due, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - due[r.source]) < 1e-3
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - due[s]) <= max(1, 0.01 * due[s]), s
    again = mixing.taken_words(*mixing.mix_sources(df.repartition(7))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_documents_hold_what_is_taken(documents):
    df = documents(mixed_rows())
    taken = Counter()
    for r in mixing.taken_words(*mixing.mix_sources(df)).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    found = Counter()
    for r in out.collect():
        found[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert found == +taken


def test_permutation_is_one():
    for n in (1, 2, 3, 10, 64, 1000, 4097):
        places = mixing.permute(np.arange(n), n, 9)
        assert sorted(places.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), 1000, 9).tolist() != mixing.permute(np.arange(1000), 1000, 10).tolist()


def test_quality(spark, documents):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "abcd efgh"), (5, "again the same id"), (1002, "ab " * 50_000)]
    labels += [(1, 1, 0), (None, 1, 0), (2, None, 0), (5000, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = classify(documents(rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    known = {d: q for d, q, _ in labels if q is not None}
    held = [r for r in got if r.held_out and r.doc_id in known and r.doc_id != 5]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 50 and np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.97
    # labels that are held out change nothing
    turned = spark.createDataFrame([(d, q if d is None or q is None or zlib.crc32(str(d).encode()) % 4 != 2 else 1 - q, t) for d, q, t in labels], marks.schema)
    assert (fit_quality(documents(rows), turned) == fit_quality(documents(rows), marks)).all()
    nothing = classify(documents(rows), marks.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def test_empty_tables(spark, documents):
    none = documents([])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    path = scratch_path(spark, "test-none")
    name = tokenizer_path("word_bpe_49k.json")
    simple8b.write_ids(none, path, name)
    for df in (
        similar_groups(none),
        remove_repeats(none),
        mixing.taken_words(*mixing.mix_sources(none)),
        mixing.mixed_documents(none),
        packing.pack(none, tokenizer_path("byte_bpe_50k.json")),
        counts.count_tokens(none, tokenizer_path("piece_bpe_32k.model")),
        classify(none, labels),
        simple8b.read_ids(spark, path),
    ):
        assert df.collect() == []
