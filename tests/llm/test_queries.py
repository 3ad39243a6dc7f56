"""Every registered query of this part on the smallest tables, against its SQL or a plain version."""

import hashlib
import zlib
from array import array
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from tests.llm.test_operators import plain_components, plain_measures, plain_print, plain_repeats, plain_verdicts, same, whole_ids
from tests.test_entry import SF, TABLES, plain

from edgeloom.llm import packing, queries, toxicity


@pytest.fixture(scope="module")
def rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def found(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame, cursor = queries.queries()[name](spark, SF), db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert plain(frame.columns, map(tuple, frame.collect())) == plain(columns, cursor.fetchall())


def test_op1(spark, rows):
    out = found(spark, "op1_toxicity")
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    clean = [r.predicted for r in out if r.held_out and labels.get(r.doc_id) == 0]
    assert sum(clean) <= 0.1 * len(clean)
    assert sorted(map(tuple, out)) == sorted(map(tuple, found(spark, "op1_toxicity")))


def test_op1_learns_from_training_rows_only(spark, tmp_path):
    for table in ("documents", "labels"):
        frame = spark.read.parquet(f"{SF}/{table}.parquet")
        if table == "labels":  # held-out labels turned over
            flipped = [(r.doc_id, r.quality, 1 - r.toxic if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.toxic) for r in frame.collect()]
            frame = spark.createDataFrame(flipped, frame.schema)
        frame.write.parquet(str(tmp_path / f"{table}.parquet"))
    other = sorted((r.doc_id, round(r.score, 5)) for r in queries.op1_toxicity(spark, str(tmp_path)).collect())
    assert other == sorted((r.doc_id, round(r.score, 5)) for r in found(spark, "op1_toxicity"))


def test_op4(spark, rows):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found(spark, "op4_best_fit_packing"):
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        ids, at, wanted = [*whole_ids(text), packing.END_ID], 0, []
        for piece, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            wanted.append((piece, at, n, zlib.crc32(array("I", ids[at : at + n]).tobytes())))
            at += n
        assert sorted(pieces[i]) == wanted
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for own in sequences.values() for _, n in own)
    assert len(sequences) <= -(-total // 1024) + 3


def test_op5(spark, rows):
    wanted = {i: (len((t or "").encode()), n, k, hashlib.sha256(kept).hexdigest()) for (i, t), (_, kept, n, k) in zip(rows, plain_repeats(rows, 400))}
    passages = {i: n for i, _, n, _ in plain_repeats(rows, 200, True)}
    out = found(spark, "op5_substring_dedup")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == wanted and {r.doc_id: r.n_passage for r in out} == passages


def test_op6(spark, rows):
    start, wanted = 0, []
    for i, text in sorted(rows):
        ids = [*whole_ids(text), 0]
        wanted.append((i, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    same([tuple(r) for r in found(spark, "op6_token_planes")], wanted)


def test_op7(spark, rows):
    prints = {i: plain_print(t) for i, t in rows}
    group, least = plain_components(set(prints.values()), 4), {}
    for i, p in prints.items():
        least[group[p]] = min(i, least.get(group[p], i))
    same([tuple(r) for r in found(spark, "op7_simhash")], [(i, f"{p:016x}", least[group[p]]) for i, p in prints.items()])


def test_op10(spark, rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = {r.doc_id: (*(r[n] for n in names), r.kept) for r in found(spark, "op10_quality_rules")}
    assert out == {i: (*plain_measures(t), kept) for (i, t), (_, kept) in zip(rows, plain_verdicts([t for _, t in rows]))}
