"""Each operator against a plain version of itself, on fixtures with nulls, repeats, ties and clashing names."""

import base64
import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.llm.conftest import sentence

from edgeloom.llm import chat, components, decontaminate, packing, quality, simhash, storage, substring_dedup, token_planes, tokens, toxicity, url_filter, warc, windows

FIELDS = ["doc_id", "text"]


def same(found, wanted):
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def doc_rows(docs):
    return [(r.doc_id, r.text) for r in docs.select(*FIELDS).collect()]


# tokens and plane files


def whole_ids(text):
    library = tokens.encoder(tokens.DEFAULT_TOKENIZER).tokenizer
    return library.encode(text or "", add_special_tokens=False).ids


def test_units_give_the_librarys_ids(texts):
    odd = ["", "  ", " a", "a ", "it's a.b,c! x's", "a\u00a0b c", "a\n x", "!!\nA!! b", "x.\nY", "ein 1\n2 3", "été,\nÜber", "it's\n's a"]
    for text, ids in zip(texts + odd, tokens.Encoder().encode_all(texts + odd)):
        assert ids == array("I", whole_ids(text)).tobytes(), text


def test_full_cache(monkeypatch, texts):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    encoder = tokens.Encoder()
    assert encoder.encode_all(texts) == tokens.Encoder().encode_all(texts) and len(encoder.cache) <= 5


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes(kind, n):
    ids = np.random.default_rng(1).integers(0, 1 << 32 if n == 7 else 50_000, n).astype("<u4")
    assert (token_planes.from_planes(token_planes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(spark, docs, kind):
    folder = storage.new_folder(spark, "t")
    manifest = token_planes.write_tokens(docs, folder, kind=kind, block_ids=256, files=3)
    read = token_planes.read_tokens(manifest, folder, lambda _, ids: (len(ids) // 4, ids), "n_tokens long, ids binary").collect()
    rows = [(r.doc_id, bytes(r.ids)) for r in read]
    same(rows, [(i, array("I", [*whole_ids(t), 0]).tobytes()) for i, t in doc_rows(docs)])
    at = 0
    for r in sorted(read, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(read, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    name = manifest.orderBy("file_no").first().name
    system, path = storage.open_folder(folder)
    with system.open_input_file(f"{path}/{name}") as source:
        reader = token_planes.PlaneReader(source, source.size())
        every = np.frombuffer(b"".join(x for _, x in reader.documents()), "<u4")
        assert (reader.span(100, 700) == every[100:700]).all() and len(reader.span(5, 5)) == 0


def test_token_files_empty(none):
    assert token_planes.token_digests(none).count() == 0


# packing


def test_pack(docs):
    rows = packing.pack(docs, capacity=64).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.sequence_id].append((r.offset, r.length))
    for own in pieces.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    ids = Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows)
    want = Counter()
    for i, t in doc_rows(docs):
        one, at = [*whole_ids(t), 2], 0
        for piece, n in enumerate(packing.cut_lengths(len(one), 64)):
            want[i, piece, at, n, array("I", one[at : at + n]).tobytes()] += 1
            at += n
    assert ids == want
    assert len(pieces) <= -(-sum(r.length for r in rows) // 64) * 1.02 + 2


def test_pack_empty(none):
    assert packing.pack(none).count() == 0 and packing.solve({}) == []


def test_solve_is_close_to_the_bound():
    pick = np.random.default_rng(2)
    lengths = np.minimum(1024, pick.lognormal(5.5, 1, 40_000).astype(int) + 1)
    histogram = dict(Counter(lengths.tolist()))
    plan, used = packing.solve(histogram), Counter()
    for config, n in plan:
        assert sum(k * m for k, m in config.items()) <= 1024
        for k, m in config.items():
            used[k] += m * n
    assert used == histogram
    assert sum(n for _, n in plan) <= 1.001 * -(-lengths.sum() // 1024)


def test_program_beats_best_fit():
    """Best fit puts 523 with 277, and the rest in threes and fours: 11,000 sequences. 9,000 hold all."""
    histogram = {523: 6000, 277: 6000, 267: 6000, 234: 12000}
    lengths, counts = np.array(sorted(histogram)), np.array([histogram[n] for n in sorted(histogram)])
    assert sum(n for _, n in packing.best_fit(lengths, counts, 1024)) == 11_000
    plan = packing.solve(histogram)
    assert sum(n for _, n in plan) <= 9_010
    programs, rest = packing._packed(lengths, counts, 1024, packing.ROUNDS, 1.0, 3, packing.fractional(lengths, counts, 1024, packing.ROUNDS))
    assert sum(n for _, n in programs) > 8_900 and sum(n for _, n in rest) < 50


def test_few_pieces_are_packed_as_well_as_any():
    """Small histograms against the best of all packings."""
    def fewest(left, open_=()):
        if not left:
            return len(open_)
        size, rest = left[0], left[1:]
        found = [fewest(rest, (*open_[:i], room - size, *open_[i + 1 :])) for i, room in enumerate(open_) if room >= size and room not in open_[:i]]
        return min([*found, fewest(rest, (*open_, 20 - size))])

    pick = np.random.default_rng(3)
    for _ in range(15):
        pieces = sorted(pick.integers(1, 20, 8).tolist(), reverse=True)
        assert sum(n for _, n in packing.solve(dict(Counter(pieces)), capacity=20)) <= fewest(pieces) + 1


# repeated passages


def plain_passage(data, begin, end):
    whole = [m for m in re.finditer(rb"[^\x20\x09-\x0d]+", data) if begin <= m.start() and m.end() <= end]
    return end - begin >= 400 or len(whole) > 50


def plain_edges(gone):
    return np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).reshape(-1, 2).tolist()


def plain_short_words(b, length, seen=None):
    """Windows of 51 words that have fewer than ``length`` bytes; with ``seen``, the ranges of those that occur twice."""
    found = list(re.finditer(rb"[^ \t-\r]+", b))
    some = [(tuple(m[0] for m in found[p : p + 51]), p) for p in range(len(found) - 50)]
    some = [x for x in some if sum(map(len, x[0])) + 50 < length]
    if seen is None:
        return [x[0] for x in some]
    gone = np.zeros(len(found), bool)
    for words, p in some:
        gone[p : p + 51] |= seen[words] > 1
    return [(found[x].start(), found[y - 1].end()) for x, y in plain_edges(gone)]


def plain_repeats(rows, length, passages_only=False):
    seen, out = Counter(), []
    short = Counter(x for _, t in rows for x in plain_short_words((t or "").encode(), length)) if passages_only else None
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = [(x, y) for x, y in plain_edges(gone) if not passages_only or plain_passage(b, x, y)]
        if passages_only:
            gone[:] = False
            for x, y in [*spans, *plain_short_words(b, length, short)]:
                gone[x:y] = True
            spans = plain_edges(gone)
        kept = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(b)]))
        out.append((i, kept, sum(y - x for x, y in spans), len(spans)))
    return out


@pytest.mark.parametrize("length, passage", [(80, None), (400, 200), (200, 80)])
def test_repeats(docs, length, passage):
    found = substring_dedup.remove_repeats(docs, length, passage=passage)
    rows = doc_rows(docs)
    same([(r.doc.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in found.collect()], plain_repeats(rows, length))
    if passage:
        same([(r.doc.doc_id, r.n_passage) for r in found.collect()], [(i, n) for i, _, n, _ in plain_repeats(rows, passage, True)])


def test_short_passages(spark):
    """Passages of over 50 words and under 400 bytes, and shorter ones, in documents that are otherwise of their own."""


    pick = random.Random(3)
    passages, shorter = [sentence(pick, 51) for _ in range(3)], [sentence(pick, 49) for _ in range(3)]
    rows = [(i, f"{sentence(pick, 30 + i)}. {passages[i % 3]} . {sentence(pick, 40)}") for i in range(12)] + [(100 + i, f"{sentence(pick, 120)}. {shorter[i % 3]} .") for i in range(12)]
    assert all(250 < len(p) < 400 for p in passages)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    short = {r.doc.doc_id: bytes(r.kept).decode() for r in substring_dedup.remove_repeats(frame, substring_dedup.PASSAGE, passages_only=True).collect()}
    assert not any(p in short[i] for p in passages for i in range(12)) and all(short[i] == t for i, t in rows if i >= 100)
    both = {r.doc.doc_id: (r.n_removed, r.n_passage) for r in substring_dedup.remove_repeats(frame, passage=substring_dedup.PASSAGE).collect()}
    assert all(both[i][0] == 0 and both[i][1] >= len(passages[i % 3]) for i in range(12)) and all(both[i] == (0, 0) for i in range(100, 112))


@pytest.mark.parametrize("segment", [1 << 20, 40])
def test_passages_of_short_words(spark, monkeypatch, segment):
    """51 to 70 words under 200 bytes, also of other white space, in copies, at a text's ends and beside longer passages."""


    monkeypatch.setattr(substring_dedup, "SEGMENT", segment)
    pick = random.Random(8)
    short = lambda n: " ".join("".join(pick.choice("abé") for _ in range(pick.randrange(1, 3))) for _ in range(n))
    passages, texts = [short(n) for n in (51, 55, 70, 50)], ["", None, "a", " ".join("a" * 51), "  " + " ".join("a" * 51)]
    for i in range(24):
        own = f"{short(i)} {passages[i % 4]} {sentence(pick, 30) if i % 3 else short(40)}"
        texts.append(own.replace(" ", "\n ") if i % 5 == 4 else own)
    texts += [passages[0], passages[1] + " " + passages[2], texts[6], texts[6], f"{passages[2]} {texts[8]}", short(400), "b " * 120]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_repeats(rows, 200, True)
    assert sum(n > 0 for _, _, n, _ in want) > 15
    found = substring_dedup.remove_repeats(frame, 200, passages_only=True).collect()
    same([(r.doc.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in found], want)
    both = substring_dedup.remove_repeats(frame, passage=200).collect()
    same([(r.doc.doc_id, r.n_passage) for r in both], [(i, n) for i, _, n, _ in want])
    same([(r.doc.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in both], plain_repeats(rows, 400))


def test_repeats_of_near_copies_and_segments(spark, monkeypatch):

    monkeypatch.setattr(substring_dedup, "SEGMENT", 100)
    pick = random.Random(5)
    base, rows = "".join(pick.choice("ab ") for _ in range(900)), []
    for i in range(25):
        copy = list(base)
        for _ in range(i % 4):
            copy[pick.randrange(900)] = "Z"
        rows.append((i, "".join(copy[pick.randrange(50) :])))
    rows += [(100, "abc" * 200), (101, "q" * 300), (102, "abc" * 90)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 200, passage=80)
    same([(r.doc.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in found.collect()], plain_repeats(rows, 200))
    same([(r.doc.doc_id, r.n_passage) for r in found.collect()], [(i, n) for i, _, n, _ in plain_repeats(rows, 80, True)])


def test_repeated_passage_is_one_stretch(spark):
    pick = random.Random(9)
    passage = sentence(pick, 500)
    rows = [(i, f"{sentence(pick, 60)} {i} {passage} {i} {sentence(pick, 60)}") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select(F.unhex(F.md5("text")).alias("digest"), "text")
    found = substring_dedup.repeated_spans(frame, (200,)).collect()
    assert [(len(r.spans0), r.copies) for r in found] == [(1, None)] * 20
    assert all(0 <= r.spans0[0].w - (len(passage) + 2 - 199) < 10 for r in found)  # a neighbour's letter may be the same


def test_runs_of_pieces():
    """Runs of texts looked at together are those of each text."""
    pick = np.random.default_rng(4)
    pieces = [pick.integers(97, 100, n).astype(np.uint8) for n in (80, 81, 400, 80, 1000)] + [np.full(300, 97, np.uint8)] * 2
    together = np.stack(substring_dedup._runs_of(pieces, 80), axis=1).tolist()
    assert together == [[i, *run[1:]] for i, piece in enumerate(pieces) for run in np.stack(substring_dedup._runs_of([piece], 80), axis=1).tolist()]


def test_repeats_whole_characters(spark):
    rows = [(0, "é" * 50 + "ü" * 40), (1, "xé" + "é" * 50)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 80, whole_characters=True)
    assert all(bytes(r.kept).decode() is not None for r in found.collect())


def test_repeats_empty(none):
    assert substring_dedup.remove_repeats(none).count() == 0


def test_runs_depend_on_content():
    data = np.frombuffer(bytes(np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)), np.uint8)
    buckets = windows.q_buckets(data, 10)
    first, at = windows.runs(buckets, 31)
    for f, a, end in zip(first, at, [*first[1:], len(buckets) - 30]):
        for p in (f, end - 1):
            assert p + buckets[p : p + 31].argmin() == a


# near-duplicates


def plain_print(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= radius:
                root[find(b)] = find(a)
    return {v: find(v) for v in values}


def plain_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """Each text's group: within 4 bits, or sets of shingles with a similarity of 0.8 or more."""
    texts = list(dict.fromkeys(texts))
    prints, sets = [plain_print(t) for t in texts], [plain_set(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = bin(prints[i] ^ prints[j]).count("1") <= 4 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0
            if near and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return dict(zip(texts, group))


def test_keep_one_of_looser_copies(spark):
    pick = random.Random(21)
    rows, clean = [], []
    for n in (30, 60, 150, 400, 2500):
        for _ in range(12):
            words = sentence(pick, n).split()
            rows.append(" ".join(words))
            for share in (60, 40, 15):  # of words to a changed one: similarity of about 0.85, 0.78 and 0.5
                changed = list(words)
                for at in pick.sample(range(n), max(1, n // share)):
                    changed[at] = f"other{pick.randrange(10**6)}"
                rows.append(" ".join(changed))
    clean = [sentence(pick, 100) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(rows + clean)), "doc_id long, text string").repartition(4)
    group, least = plain_groups(rows + clean), {}
    for i, t in enumerate(rows + clean):
        least.setdefault(group[t], i)
    kept = [r.doc_id for r in simhash.keep_one(frame).select("doc_id").collect()]
    wanted = set(least.values())
    assert wanted <= set(kept) and len(kept) == len(set(kept))
    # all but at most one in a hundred of the rows to drop go
    assert len(set(kept) - wanted) <= 0.01 * (len(rows) + len(clean) - len(wanted)) and len(wanted) < len(rows) + len(clean) - 50
    assert set(range(len(rows), len(rows) + 60)) <= set(kept)


def test_all_of_a_bucket_are_compared(spark):
    # one bucket, in which two families are unlike its smallest and largest fingerprint, and strangers have a passage in common
    pick = random.Random(3)
    passage, far = sentence(pick, 100), [sentence(pick, 100) for _ in range(4)]
    texts = [far[0], *(f"{far[1]} {w}" for w in ("one", "two", "three")), *(f"{far[2]} {w}" for w in ("one", "two")), *(f"{passage} {sentence(pick, 60)}" for _ in range(3)), far[3]]
    fps = sorted(pick.getrandbits(64) - (1 << 63) for _ in texts)
    rows = spark.createDataFrame([(fp, [1]) for fp in fps], "fp long, parts array<long>")
    named = spark.createDataFrame(list(zip(fps, texts)), "fp long, text string")
    none = spark.createDataFrame([], "u long, v long")
    with storage.Scratch(spark, "t") as scratch:
        found = simhash.set_links(rows, lambda asked: named.join(asked, "fp"), scratch, none)
        label = {r.node: r.component for r in components.components(found).collect()}
    at = {fp: i for i, fp in enumerate(fps)}
    assert {at[fp]: at[c] for fp, c in label.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_keep_one_takes_ids_of_any_type(spark):
    text = sentence(random.Random(1), 80)
    frame = spark.createDataFrame([("b", text), ("a", text.upper()), (None, text), ("c", None), ("d", ""), ("e", "one")], "doc_id string, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == ["a", "c", "e"]


def test_near_duplicates(docs):
    rows = doc_rows(docs)
    prints = [plain_print(t) for _, t in rows]
    group, least = plain_components(set(prints), 4), {}
    for (i, _), p in zip(rows, prints):
        least[group[p]] = min((x for x in (least.get(group[p]), i) if x is not None), default=None)
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    same(found, [(i, f"{p:016x}", least[group[p]]) for (i, _), p in zip(rows, prints)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(plain_groups([t for _, t in rows]).values()))


@pytest.fixture
def plans(monkeypatch):
    """The physical plans of the tables that operators store from here on."""
    found = []

    def told(store):
        def stored(*args):
            frame = next(a for a in args if isinstance(a, DataFrame))
            found.append(frame._jdf.queryExecution().executedPlan().toString())
            return store(*args)

        return stored

    monkeypatch.setattr(storage, "cut", told(storage.cut))
    monkeypatch.setattr(storage.Scratch, "cut", told(storage.Scratch.cut))
    return found


def test_near_duplicates_broadcast_nothing(docs, plans, monkeypatch):
    # the tables here are small, as Spark takes them to be after an explode
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, 1))
    simhash.near_duplicates(docs)
    assert sum("Join" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)


def test_stages_broadcast_only_what_is_summed_up(spark, docs, plans, monkeypatch):
    for module in (storage, decontaminate):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    items = spark.createDataFrame([(1, docs.where("doc_id = 1").first().text)], "item_id long, text string")
    results = [simhash.keep_one(docs), substring_dedup.remove_repeats(docs, 200, passages_only=True), decontaminate.clean(docs, items)]
    plans += [frame._jdf.queryExecution().executedPlan().toString() for frame in results]
    assert sum("Join" in p for p in plans) > 12 and not any("Broadcast" in p for p in plans)


def test_near_duplicates_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_covering():
    pick, masks = np.random.default_rng(4), simhash.masks()
    assert len(masks) == 31
    for _ in range(3000):
        differing = sum(1 << int(i) for i in pick.choice(64, 4, replace=False))
        assert any(not m & differing for m in masks)


@pytest.mark.parametrize("small", [2048, 3])
def test_links_in_crowded_buckets(spark, small):
    pick = np.random.default_rng(9)
    centres = [int(x) for x in pick.integers(0, 1 << 63, 4)]
    values = {c ^ sum(1 << int(i) for i in pick.choice(64, int(pick.integers(0, 5)), replace=False)) for c in centres for _ in range(30)}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(frame, lambda f: storage.cut(f, "t"), small=small)).collect()}
    wanted = plain_components(values, 4)
    groups = lambda m: sorted(sorted(v for v in m if m[v] == c) for c in set(m.values()))
    single = {v: found.get(v - (1 << 64) if v >> 63 else v, v) for v in values}
    assert groups(single) == groups(wanted)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in components.components(chain).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100}


# decontamination


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def items(spark, texts):
    cut = " ".join(texts[0].split()[3:25])
    rows = [(1, cut.upper()), (2, texts[5]), (3, "one"), (4, None), (5, ""), (6, "not there at all"), (7, "word word word"), (8, "ÄPFEL ñandú"), (9, " ".join(texts[1].split()[:9])), (10, cut)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(docs, items):
    windows_of = defaultdict(set)
    for r in items.collect():
        w = plain_words(r.text)
        for i in range(max(0, len(w) - 9) or bool(w)):
            windows_of[tuple(w[i : i + 10])].add(str(r.item_id))
    wanted = []
    for i, t in doc_rows(docs):
        w, hit, found = plain_words(t), set(), set()
        for n in {len(k) for k in windows_of}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows_of:
                    hit.update(range(p, p + n))
                    found |= windows_of[tuple(w[p : p + n])]
        wanted.append((i, len(w), len(hit), sorted(found), bool(hit)))
    found = decontaminate.contamination(docs, items).collect()
    same([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found], wanted)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()], [i for i, _, n, _, _ in wanted if not n])


def test_contamination_empty(docs, none, items):
    assert decontaminate.contamination(none, items).count() == 0
    clean = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(clean) == docs.count() and not any(r.contaminated for r in clean)


def test_contamination_at_the_ends_of_documents(spark):
    item = [f"w{i}" for i in range(20)]
    texts = [item[a:b] for a in range(20) for b in range(a + 8, 21)]
    texts = [[*t, "other", "words"] for t in texts if t[0] != "w0"] + [["other", *t] for t in texts if t[-1] != "w19"]
    rare = [w for w in item if w != "w9"]
    docs = [" ".join(t) for t in [*texts, *([rare[::-1]] * 300)]]  # w9 is the rarest word of all windows that have it
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    found = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(frame, items).collect()}
    sizes = [sum(w in item for w in t) for t in texts] + [0] * 300
    assert found == {i: (n, ["a"], True) if n >= 10 else (0, [], False) for i, n in enumerate(sizes)}


def test_near(spark):
    docs = spark.createDataFrame([(1, "a b x y c d"), (2, "a b c"), (3, "c x x x a b")], "doc_id long, text string")
    phrase = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    same([(r.doc_id, r["first"]) for r in decontaminate.near(docs, phrase, 3).collect()], [(2, 0)])
    same([(r.doc_id, r["first"]) for r in decontaminate.near(docs, phrase, 5).collect()], [(1, 0), (2, 0), (3, 0)])


def test_near_against_brute_force(spark):

    pick = random.Random(6)
    docs = [" ".join(pick.choice("abcdefgh") for _ in range(pick.randrange(0, 60))) for _ in range(60)] + [None, "A b, C!"]
    phrases = [" ".join(pick.choice("abcdefgh") for _ in range(pick.randrange(1, 5))) for _ in range(12)]
    frame = spark.createDataFrame([(i, d, "x", 1) for i, d in enumerate(docs)], "doc_id long, text string, term string, uid int").repartition(3)
    items = spark.createDataFrame([(i, p, 1) for i, p in enumerate(phrases)], "item_id long, text string, pos int")
    for span in (1, 4, 9):
        wanted = []
        for i, d in enumerate(docs):
            w = plain_words(d)
            for item, phrase in enumerate(phrases):
                kinds = set(plain_words(phrase))
                wanted += [(i, str(item), p) for p in range(len(w)) if w[p] in kinds and kinds <= set(w[p : p + span])]
        same([(r.doc_id, r.item, r["first"]) for r in decontaminate.near(frame, items, span).collect()], wanted)


@pytest.mark.parametrize("limit", [0, 16_000_000])
def test_contamination_with_and_without_broadcasts(docs, items, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    test_contamination(docs, items)


# quality


def plain_measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def plain_votes(text):
    """The rules' votes, from a text."""
    n, chars, symbols, dup, repeated, _ = plain_measures(text)
    words, lines = re.findall("[^\x20\x09-\x0d]+", text or ""), [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    kinds = sum(len(set(words[i : i + 50])) for i in range(0, n, 50))
    common, stops = sum(w.lower() in quality.COMMON for w in words), len(re.findall("[.!?]", text or ""))
    m = max(1, n)
    vote = lambda bad, good: -1 if bad else int(good)
    return (
        vote(n < 50, n >= 100), vote(repeated / m > 0.1, not repeated and n >= 50), vote(symbols / m > 0.1, symbols / m < 0.01),
        vote(dup / max(1, len(lines)) > 0.2, not dup and len(lines) >= 3), vote(chars / m < 4 or chars / m > 7.5, 4.5 <= chars / m <= 6.5),
        vote(kinds / m < 0.6, kinds / m > 0.7), vote(common / m < 0.05, common / m > 0.1), vote(stops / m < 0.01 or stops / m > 0.3, 0.03 <= stops / m <= 0.2),
    )


def plain_verdicts(texts):
    """(posterior, kept) of each text: EM document by document, on arrays."""
    ok = np.array([not plain_measures(t)[-1] for t in texts])
    votes = np.array([plain_votes(t) for t in texts])
    there = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # document, rule, vote
    good = np.clip(0.5 + 0.5 * votes.sum(axis=1) / np.maximum(1, np.abs(votes).sum(axis=1)), 0.05, 0.95)
    for _ in range(quality.ROUNDS):
        g = good[ok]
        sums = np.stack([0.5 + np.tensordot(w, there[ok], 1) for w in (1 - g, g)])  # class, rule, vote
        wrong = sums[0, :, 0] / sums[0].sum(axis=1) < sums[1, :, 0] / sums[1].sum(axis=1)
        sums[:, wrong] = sums[:, wrong].sum(axis=0)
        logs = np.log(sums / sums.sum(axis=2, keepdims=True))
        score = np.einsum("drv,crv->cd", there, logs) + np.log([[1 - g.mean()], [g.mean()]])
        good = 1 / (1 + np.exp(score[0] - score[1]))
    return [(float(p), bool(k and p >= 0.5)) for p, k in zip(good, ok)]


@pytest.fixture(scope="module")
def mixed():
    """Good texts, some with one thing to object to, and junk of two kinds."""

    pick = random.Random(8)
    vowels, others, common = "aeiou", "bdfgklmnprst", [w for w in quality.COMMON if len(w) > 1]
    word = lambda n: "".join(pick.choice(others) + pick.choice(vowels) for _ in range(n))
    def prose(n, stop=12):
        words = [pick.choice(common) if pick.random() < 0.25 else word(pick.choice((2, 3, 4))) for _ in range(n)]
        return " ".join(w + "." * (i % stop == stop - 1) + "\n" * (i % 40 == 39) for i, w in enumerate(words))
    few = [word(2) for _ in range(12)]
    texts = [prose(pick.randrange(60, 300)) for _ in range(150)]
    texts += [prose(pick.randrange(25, 45)) for _ in range(8)] + [prose(200, 2) for _ in range(4)]  # short; many stops
    texts += ["\n".join([line] * 3 + [prose(130)]) for line in (prose(6) for _ in range(8))]  # repeated lines
    texts += [" ".join(word(5) + "###" for _ in range(150)) for _ in range(12)]
    texts += [" ".join(pick.choice(few) + "*" * (i % 7 == 0) for i in range(160)) for _ in range(10)]
    return texts + [None, "", "too short", "word " * 100]


def test_measures(spark, docs):
    extra = ["a b c d e f g h " * 3, "x\nx\n x\nx\n\n", "# $ & | < > %", " ".join("abcdefghij") + " " + " ".join("abcdefgh") + " " + "z " * 40]
    frame = docs.select(*FIELDS).unionByName(spark.createDataFrame(list(enumerate(extra, 900)), "doc_id long, text string"))
    found = quality.judge(frame, FIELDS).collect()
    rows = [(r.doc.doc_id, r.doc.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found]
    same(rows, [(i, t, *plain_measures(t)) for i, t in doc_rows(frame)])
    same([(r.doc.doc_id, tuple(r.votes)) for r in found], [(i, plain_votes(t)) for i, t in doc_rows(frame)])
    assert quality.judge(docs).select("doc.*").columns == [c for c in docs.columns if c != "text"]
    assert quality.judge(docs.limit(0)).count() == 0


def test_kept(spark, mixed):
    frame = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string").repartition(3)
    wanted = plain_verdicts(mixed)
    found = {r.doc.doc_id: (r.quality, r.kept) for r in quality.judge(frame).collect()}
    assert all(found[i][1] == kept and abs(found[i][0] - p) < 1e-6 for i, (p, kept) in enumerate(wanted))
    stay = {r.doc_id for r in quality.keep_good(frame.withColumn("a", F.lit("clash"))).collect()}
    assert stay == {i for i, (_, kept) in enumerate(wanted) if kept}
    # one objection is forgiven, several together are not: neither all-must-pass nor none
    votes = [plain_votes(t) for t in mixed]
    forgiven = [i for i in stay if -1 in votes[i]]
    assert len(forgiven) >= 15 and all(i in stay for i in range(150)) and not any(i in stay for i in range(170, len(mixed)))


def test_keep_good_of_hygiene(docs):
    kept = quality.keep_good(docs)
    verdicts = dict(zip([t for _, t in doc_rows(docs)], plain_verdicts([t for _, t in doc_rows(docs)])))
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t in doc_rows(docs) if verdicts[t][1]])


def test_posterior_and_all_must_pass():
    patterns = [((1, 1, 1, 1), 900), ((1, 1, 1, 0), 300), ((-1, 1, 1, 1), 40), ((1, -1, 1, 1), 30), ((1, -1, -1, -1), 60), ((0, -1, -1, 1), 40), ((-1, 1, -1, -1), 20)]
    prior, voting = quality.fit(patterns)
    chances = {v: quality.posterior(v, prior, voting) for v, _ in patterns}
    assert min(chances[v] for v in ((1, 1, 1, 1), (1, 1, 1, 0), (-1, 1, 1, 1), (1, -1, 1, 1))) > 0.5
    assert max(chances[v] for v in ((1, -1, -1, -1), (0, -1, -1, 1), (-1, 1, -1, -1))) < 0.01
    assert 0.85 < prior < 0.95 and voting[2][0][-1] > 0.9 > 0.01 > voting[2][1][-1]


# urls


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1?x", "http://example.net/de/", "http://net/", "http://net", "ftp://x.org/fr/a#b", "http://x.org?q", None, "no url", "http://example.com/de/x", "http://b.co.uk:80/", "x://", "http://a\nb/c"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, bound string")
    none = spark.createDataFrame([(None, 1), (3, None)], "page_id long, good int")
    found = {r.page_id: r for r in url_filter.judge(pages, none).collect()}
    assert [found[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", "net/", None, "org/fr/", None, None, None, "example.com/de/", None, None, None]
    assert found[0].host == "a.example.net" and found[0].path == "/en/1" and found[5].path == "" and found[6].host == "" and found[11].host == "a\nb"
    assert (found[0].verdict, found[1].verdict, found[4].verdict, found[8].verdict) == ("allow", "block", "allow", "block")
    assert url_filter.judge(pages, none).count() == len(urls) + 1
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_levels_and_suffixes(spark):
    hosts = ["a.b.example.co.uk", "shop.com.mx", "x.ne.jp:80", "www.site.org", "localhost", "", "deep.k12.ca.us", "co.il"]
    frame = spark.createDataFrame([(h, "x") for h in hosts], "host string, names string")
    levels = {r.host: (r.domain, r.suffix) for r in url_filter.with_levels(frame).collect()}
    assert levels == {"a.b.example.co.uk": ("example.co.uk", "co.uk"), "shop.com.mx": ("shop.com.mx", "com.mx"), "x.ne.jp:80": ("x.ne.jp", "ne.jp"), "www.site.org": ("site.org", "org"),
                      "localhost": ("localhost", "localhost"), "": ("", ""), "deep.k12.ca.us": ("ca.us", "us"), "co.il": ("co.il", "co.il")}
    listed = spark.createDataFrame([("k12.ca.us",), ("ca.us",), ("org",)], "suffix string")
    found = {r.host: (r.domain, r.suffix) for r in url_filter.with_levels(frame, listed).collect()}
    assert found == levels | {"deep.k12.ca.us": ("deep.k12.ca.us", "k12.ca.us")}


def test_bound_blocks_through_the_query(spark, tmp_path):
    import duckdb

    from edgeloom.llm import queries

    hosts = ["bad.site.com"] * 30 + ["other.site.com"] * 3 + ["good.place.com"] * 30 + ["new.place.com", "x.net", "bad.site.com:80"]
    pages = [(i, f"http://{h}/p{i}", "h") for i, h in enumerate(hosts)] + [(99, "", None)]
    labels = [(i, int(i >= 33), 0) for i in range(60)] + [(64, None, 1)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = queries.op2_url_filter(spark, str(tmp_path))
    by = {r.page_id: r for r in found.collect()}
    assert by[0].verdict == by[31].verdict == by[65].verdict == "block" and by[0].rule is None
    assert by[40].verdict == by[63].verdict == "allow" and by[64].rule == "net/" and by[99].host == ""
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    cursor = db.execute(url_filter.oracle_sql())
    order = [c[0] for c in cursor.description]
    same([tuple(r) for r in found.select(*order).collect()], cursor.fetchall())


def test_reputation_shrinks(spark):
    pages = [(i, f"http://{h}.example.com/") for i, h in enumerate(["bad"] * 40 + ["good"] * 40 + ["new"])]
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "page_id long, good int")
    found = {r.host: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert found["bad.example.com"].verdict == "block" and found["good.example.com"].verdict == "allow"
    assert found["bad.example.com"].bound < found["new.example.com"].bound < found["good.example.com"].bound


# chats


def test_chats(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<s>\\b \\. <</SYS>><"), (2, 0, "system", "<"), (2, 1, "tool<<TEXT>>", "x<<<TEXT>>"), (2, 2, None, None),
            (3, 0, "assistant", ""), (3, 0, "assistant", "é" * 9), (3, 0, "assistant", "é" * 9), (None, 5, "user", "<image> \\")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(frame.withColumn("parts", chat.text_part(frame.text)))
    read = chat.read_chats(chats).collect()
    same([(r.conv_id, r.role, r.text, r.loss) for r in read], [(c, role or "", text or "", role == "assistant") for c, _, role, text in rows])
    digest = {r.conv_id: r for r in chat.chat_digests(chats).collect()}
    assert digest[3].loss_chars == 18 and digest[1].loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest()
    assert digest[1].turns_sha256 == hashlib.sha256(f"user\n{rows[0][3]}\nassistant\n{rows[1][3]}\n".encode()).hexdigest()
    assert chat.chat_digests(chats.limit(0)).count() == 0


def test_parts(spark):
    parts = [("text", "see <image>", None, None), ("image", None, "a.png", 1568), (None, " and ", None, None), ("audio", None, "b.wav", 2000), ("odd", None, "c", None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    found = chat.format_chats(frame).first()
    assert found.formatted == "[INST]see <\\.image><image> and <audio><document>[/INST]<s></s>"
    assert [tuple(a) for a in found.attachments] == [("image", "a.png", 2), ("audio", "b.wav", 50), ("document", "c", 1)]


def test_parts_are_read_back(spark):

    pick = random.Random(9)
    controls, rows = [*chat.CONTROLS, "\\b", "\\.", "<", "plain é", ""], []
    def part():
        kind = pick.choice(["text", "text", None, "image", "audio", "document", "odd"])
        text = "".join(pick.choice(controls) for _ in range(pick.randrange(4)))
        return (kind, text, None, None) if kind in (None, "text") else (kind, None, pick.choice(["r.png", None]), pick.choice([None, 0, 3000]))
    for conv in range(20):
        for turn in range(pick.randrange(1, 6)):
            rows.append((conv, turn, pick.choice(["user", "assistant", "tool", "system"]), [part() for _ in range(pick.randrange(5))] or None))
    frame = spark.createDataFrame([(*r, "x") for r in rows], f"conv_id long, turn long, role string, parts {chat.PARTS}, flat string")

    def merged(parts):
        out = []
        for kind, text, ref, size in parts or []:
            kind = kind or "text"
            if kind == "text":
                if out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + text, None, None)
                else:
                    out.append(("text", text, None, None))
            else:
                kind = kind if kind in chat.EXPANSION else "document"
                n, per = chat.EXPANSION[kind]
                out.append((kind, None, ref, max(1, -(-(size or 0) * n // per))))
        return [p for p in out if p[1] != ""]

    found = {(r.conv_id, r.turn_no): (r.role, [tuple(p) for p in r.parts]) for r in chat.read_parts(chat.format_chats(frame)).collect()}
    assert found == {(c, t): (role, merged(parts)) for c, t, role, parts in rows}


# WARC


def test_warc(spark):
    rows = [(1, "http://a/ b", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "other"), (None, "n", "<p>é"), (5, "u\r\nX: y", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = warc.archive_records(pages).collect()
    by = defaultdict(list)
    for r in found:
        by[r.page_id].append((r.record_type, r.refers_to))
        text = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        assert r.payload_bytes == len(text) and r.payload_digest == base64.b32encode(hashlib.sha1(text).digest()).decode()
    assert by[1] == by[None] == [("revisit", 2)] and by[2] == by[4] == [("response", None)] and by[3] == [("revisit", 4)]
    assert sorted(by[5], key=repr) == [("response", None), ("revisit", 5)]
    assert warc.archive_records(pages.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 5])
@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_warc_repeated_rows(spark, partitions, broadcast):
    rows = [(5, "u", "same")] * 40 + [(5, "v", "same"), (5, None, "same"), (4, "w", "same"), (9, "x", "other"), (9, "x", "other"), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, sha1 string, keeper int").repartition(partitions)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive_records(pages).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {(5, "response", None): 1, (5, "revisit", 5): 41, (4, "revisit", 5): 1, (9, "response", None): 1, (9, "revisit", 9): 1, (None, "response", None): 1, (None, "revisit", None): 1}


def test_very_long_values(spark):
    html, url, text = "<p>é</p>" * 400_000, "http://a.example.com/" + "x/" * 60_000, "</s>word " * 80_000
    pages = spark.createDataFrame([(1, url, html, "h"), (2, url, html, "h"), (3, None, "", "h")], "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in warc.archive_records(pages).collect()}
    assert found[2].payload_bytes == len(html.encode()) and (found[1].record_type, found[1].refers_to) == ("revisit", 2)
    judged = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, good int")).collect()}
    assert judged[1].path == url[20:] and judged[3].host == "" and judged[1].host == "a.example.com"
    rows = spark.createDataFrame([(1, 0, "user", text, "p"), (1, 1, "assistant", text, "p")], "conv_id long, turn long, role string, text string, piece string")
    one = chat.chat_digests(chat.format_chats(rows.withColumn("parts", chat.text_part(rows.text)))).first()
    assert one.loss_chars == len(text) and one.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_warc_selected_and_small(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 2 else f"page {i}") for i in range(40)], "page_id long, url string, html string")
    folder = storage.new_folder(spark, "w")
    index = warc.write_warcs(pages, folder, least_bytes=5)
    assert {r.record_type for r in warc.read_warcs(index, folder).collect()} == {"response"}
    some = warc.read_warcs(index.where("page_id in (4, 5, 30)"), folder).collect()
    same([(r.page_id, bytes(r.payload)) for r in some], [(4, b"page 4"), (5, b"same"), (30, b"page 30")])
    assert list(warc.ranges([(0, 10), (10, 5), (200_000, 9)])) == [(0, 2, 15), (2, 1, 9)]


# toxicity


def test_toxicity(spark, docs):

    pick = random.Random(1)
    words = "lan dor min tek ros fil gan hur bel".split()
    bad = lambda: " ".join(pick.choice(words) for _ in range(30)) + " " + " ".join(pick.sample(["idiot", "moron", "scum"], 2))
    good = lambda: " ".join(pick.choice(words) for _ in range(32))
    train = spark.createDataFrame([(bad(), 1) for _ in range(60)] + [(good(), 0) for _ in range(200)] + [(None, 0), ("x", None)], "text string, toxic int")
    model = toxicity.fit(train)
    tests = spark.createDataFrame([(i, bad() if i % 2 else good()) for i in range(100)], "doc_id long, text string")
    assert sum((r.score >= toxicity.THRESHOLD) == bool(r.doc_id % 2) for r in toxicity.score(tests, model).collect()) >= 98
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(train.limit(0)).score(np.zeros(0, int)) < 1e-6
    assert toxicity.fit(train.where("toxic = 1")).score(np.zeros(0, int)) > 0.99


def test_toxicity_of_rare_words(spark):

    pick = random.Random(2)
    words = "lan dor min tek ros fil gan hur bel".split()
    rare = ["".join(pick.choice("qxzjvkwy") for _ in range(9)) for _ in range(120)]  # each in three texts, all of them toxic
    said = [w for w in rare for _ in range(3)]
    pick.shuffle(said)
    filler = lambda n: " ".join(pick.choice(words) for _ in range(n))
    train = [(f"{filler(15)} {' '.join(said[6 * i : 6 * i + 6])} {filler(15)}", 1) for i in range(60)] + [(filler(36), 0) for _ in range(600)]
    model = toxicity.fit(spark.createDataFrame(train, "text string, toxic int"))
    bad, good = [" ".join([filler(15), *pick.sample(rare, 6), filler(15)]) for _ in range(50)], [filler(36) for _ in range(50)]
    tests = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    said = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(tests, model).collect()}
    assert sum(said[i] for i in range(50)) >= 49 and sum(said[i] for i in range(50, 100)) <= 1
    assert (model.adds > 0).any() and (model.adds < 0).any()


def plain_bucket(gram):
    """A gram's bucket, a code point at a time."""
    whole = 1 << 64
    points = [ord(c) for c in gram]
    h = points[0]
    for p in points[1:]:
        h = (h * toxicity._MIX + p) % whole
    h = (h + len(gram)) * toxicity._MIX % whole
    h ^= h >> 29
    return h * toxicity._MIX % whole >> (64 - toxicity.BUCKET_BITS)


def plain_buckets(text):
    text = " " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if "\t" <= c <= "\r" else c for c in text or "") + " "
    return {plain_bucket(text[i : i + n]) for n in toxicity.ORDERS for i in range(len(text) - n + 1)}


def test_counts_ratios_and_scores_against_brute_force(spark, docs):
    pick = np.random.default_rng(5)
    texts = [t for _, t in doc_rows(docs) if len(t or "") < 400]
    labels = [int(i % 3 == 0) for i in range(len(texts))]
    rows = toxicity._hashed(spark.createDataFrame(list(zip(texts, labels)), "text string, toxic int").repartition(3))
    folds = {r.text: r.fold for r in rows.collect()}
    counts = toxicity.counted(toxicity._counts(rows))
    wanted = Counter((y, folds[t or ""], b) for t, y in zip(texts, labels) for b in plain_buckets(t))
    assert {(int(c), int(k), int(b)): int(counts[c, k, b]) for c, k, b in zip(*np.nonzero(counts))} == wanted
    toxic, clean, every = sum(labels), len(labels) - sum(labels), counts.sum(axis=1)
    ratios = toxicity.log_ratios(*every, clean, toxic)
    prior = [2 * toxicity.SMOOTHING * n / len(labels) for n in (clean, toxic)]
    for b in np.flatnonzero(every.any(axis=0))[::97]:
        assert abs(ratios[b] - np.log((every[1, b] + prior[1]) / (toxic + prior[1])) + np.log((every[0, b] + prior[0]) / (clean + prior[0]))) < 1e-5
    assert np.abs(ratios[~every.any(axis=0)]).max() < 1e-6  # a bucket without rows says nothing
    weights = pick.normal(size=1 << toxicity.BUCKET_BITS)
    found = {(r.doc_id, round(r.score, 4)) for r in toxicity.score(docs, toxicity.Model(weights, ratios, 3.0, -0.5)).collect()}
    scores = set()
    for i, t in doc_rows(docs):
        own = [float(ratios[b]) for b in plain_buckets(t)]
        total = sum(float(weights[b]) * r for b, r in zip(plain_buckets(t), own)) / max(sum(r * r for r in own) ** 0.25, 1e-9)
        scores.add((i, round(1 / (1 + np.exp(-np.clip(3 * total - 0.5, -35, 35))), 4)))
    assert found == scores


def test_descent_settles_at_the_optimum():
    pick = np.random.default_rng(3)
    rows = [np.sort(pick.choice(40, 6, replace=False)).astype(np.int32) for _ in range(80)] + [np.zeros(0, np.int32)]
    values, y = [pick.normal(size=len(r)) for r in rows], pick.integers(0, 2, 81)
    y[0], y[1] = 0, 1
    w, b = toxicity.descend(rows, values, y)
    matrix = np.zeros((81, 40))
    for i, (r, v) in enumerate(zip(rows, values)):
        matrix[i, r] = v
    balance = toxicity._balance(y)

    def loss(w, b):
        z = matrix @ w + b
        return (balance * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + toxicity.RIDGE / 2 * (w @ w)

    start, found = loss(np.zeros(40), 0.0), loss(w[:40].astype(float), b)
    v, c = np.zeros(40), 0.0
    for _ in range(4_000):
        e = balance * (1 / (1 + np.exp(-(matrix @ v + c))) - y)
        v, c = v - 2 * (matrix.T @ e + toxicity.RIDGE * v), c - 2 * e.sum()
    assert found - loss(v, c) < 0.02 * (start - loss(v, c)) and not w[40:].any()


def test_the_cut_comes_from_held_out_scores():
    z, y = np.array([3.0, 2.0, 1.0, 0.0, -1.0, -2.0]), np.array([1, 1, 0, 1, 0, 0])
    cut, slope = toxicity.cut_and_slope(z, y)
    assert cut == 1.5 and slope > 0
    assert toxicity.cut_and_slope(np.array([1.0, 2.0]), np.array([1, 0]))[0] > 2  # no cut is worth its false alarms


def held_out_quality(spark, sf):
    """Held-out recall, share of false alarms and area under the curve of the registered query."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    from edgeloom.llm import queries

    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.op1_toxicity(spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = ([r for r in rows if r[2] == y] for y in (1, 0))
    above = sum((b[0] > g[0]) + (b[0] == g[0]) / 2 for b in bad for g in good)
    return sum(r[1] for r in bad) / len(bad), sum(r[1] for r in good) / len(good), above / len(bad) / len(good)


def test_toxicity_generalises(spark):
    recall, false, area = held_out_quality(spark, "/root/testdata/sf0.01")
    assert recall >= 0.65 and false <= 0.02 and area >= 0.93


def test_a_language_without_toxic_rows_stays_clean(spark):

    pick = random.Random(11)
    first, second = ([a + b for a in x.split() for b in y.split()] for x, y in (("ba de ki lo mu ne", "lan dor min tek ros"), ("zü öx äq yé çu", "wôv ïj ûf àgh êrz")))
    insults = ["idiot", "moron", "scum", "trash"]

    def text(words, bad):
        found = [pick.choice(words) for _ in range(pick.randrange(10, 200))]
        for _ in range(bad and pick.randrange(1, 4)):
            found.insert(pick.randrange(len(found)), pick.choice(insults))
        return " ".join(found)

    train = [(text(first, True), 1) for _ in range(60)] + [(text(first, False), 0) for _ in range(150)] + [(text(second, False), 0) for _ in range(150)]
    model = toxicity.fit(spark.createDataFrame(train, "text string, toxic int"))
    tests = [(i, text((first, second)[i % 2], i % 4 == 2)) for i in range(200)]
    scores = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    bad, good = ([scores[i] for i in range(200) if (i % 4 == 2) == side] for side in (True, False))
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) >= 0.9 * len(bad) * len(good)
    assert sum(s >= toxicity.THRESHOLD for s in good) <= 2


def test_sample_is_defined_and_holds_both_classes(spark):
    rows = [("one text of many copies", 0)] * 3000 + [(f"clean {i}", 0) for i in range(300)] + [(f"toxic {i}", 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "text string, toxic int")
    samples = []
    for n in (1, 4):
        hashed = toxicity._hashed(frame.repartition(n))
        samples.append(sorted(map(tuple, toxicity._sampled(hashed, hashed.groupBy("toxic", "h", "fold").count(), 50).collect())))
    assert samples[0] == samples[1] and len(set(samples[0])) == len(samples[0]) == 100
    assert sum(y for _, y, _ in samples[0]) == 50


def test_labels_join(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    assert {(r.doc_id, r.toxic) for r in toxicity.join_labels(docs, labels).collect()} == {(0, 1)}
    assert zlib.crc32(b"1") % 3 == spark.sql("select crc32(cast('1' as binary)) % 3 r").first().r
