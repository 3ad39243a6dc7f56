"""Round trips of every file format, and malformed lines."""

import struct

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import adjacency, blocking
from edgeloom.sources import edges as sources
from edgeloom.sources import formats

DENSE = [(0, 1), (0, 3), (1, 2), (2, 0), (2, 2), (3, 0), (3, 4), (4, 1)]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(DENSE, "src long, dst long").cache()


def pairs(frame):
    return sorted(tuple(r) for r in frame.collect())


def joined(folder):
    current = folder / "_current"
    return b"".join(p.read_bytes() for p in sorted((folder / current.read_text() if current.exists() else folder).glob("part-*")))


def test_text_edges(spark, tmp_path, graph):
    path = tmp_path / "a.net"
    path.write_text("# head\n10 20\n10,20\r\n20;30\n\n 7\t8 \n%x\n-1 4\n5 6 9\n4294967296 1\n9223372036854775808 1\nx y\n3\n")
    assert pairs(sources.read_edge_list(spark, str(path))) == [(5, 6), (7, 8), (10, 20), (10, 20), (20, 30), (4294967296, 1)]
    bad = sources.read_edge_list(spark, str(path), keep_bad=True).where("bad is not null")
    assert sorted(r.bad for r in bad.collect()) == ["%x", "-1 4", "3", "9223372036854775808 1", "x y"]
    path.write_text("1 2 0\n3 4 2.5\n5 6\n7 8 # no\n")
    assert pairs(sources.read_edge_list(spark, str(path), weighted=True, comment="any")) == [(1, 2, 1.0), (3, 4, 2.5), (5, 6, 1.0)]
    sources.write_edge_list(graph, str(tmp_path / "out"))
    assert pairs(sources.read_edge_list(spark, str(tmp_path / "out"))) == DENSE
    path.write_text("")
    assert pairs(sources.read_edge_list(spark, str(path))) == []


def test_binary_csr(spark, tmp_path, graph):
    formats.write_csr(graph, str(tmp_path / "csr"))
    raw = joined(tmp_path / "csr")
    assert raw == struct.pack("<IQ6Q8I", 5, 8, 0, 2, 3, 5, 7, 8, 1, 3, 2, 0, 2, 0, 4, 1)
    assert pairs(formats.read_csr(spark, str(tmp_path / "csr"))) == DENSE
    (tmp_path / "one.bin").write_bytes(raw)
    assert pairs(formats.read_csr(spark, str(tmp_path / "one.bin"))) == DENSE
    formats.write_csr(graph, str(tmp_path / "csc"), incoming=True)
    assert pairs(formats.read_csr(spark, str(tmp_path / "csc"), incoming=True)) == DENSE
    weighted = spark.createDataFrame([(0, 1, 0.5), (1, 0, 2.0), (1, 2, -1.0)], "src long, dst long, weight double")
    formats.write_csr(weighted, str(tmp_path / "w"))
    assert pairs(formats.read_csr(spark, str(tmp_path / "w"), weighted=True)) == [(0, 1, 0.5), (1, 0, 2.0), (1, 2, -1.0)]


def test_vector(spark, tmp_path):
    values = spark.createDataFrame([(i, i * i) for i in range(100)], "place long, value long")
    formats.write_vector(values, str(tmp_path / "v"))
    assert joined(tmp_path / "v")[:12] == struct.pack("<QI", 100, 0)
    assert pairs(formats.read_vector(spark, str(tmp_path / "v"))) == [(i, i * i) for i in range(100)]
    assert formats.read_vector(spark, str(tmp_path / "missing")).count() == 0


def test_orders_sizes_degrees(spark, tmp_path, graph):
    ids = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "old_id long, new_id long")
    formats.write_vertex_order(ids, str(tmp_path / "order"), 3, 8)
    assert pairs(formats.read_vertex_order(spark, str(tmp_path / "order"))) == [(0, 2), (1, 0), (2, 1)]
    formats.write_sizes(spark, str(tmp_path / "n_m"), 5, 8)
    assert formats.read_sizes(spark, str(tmp_path / "n_m")) == (5, 8)
    formats.write_degrees(adjacency.degrees(graph), str(tmp_path / "deg"))
    assert joined(tmp_path / "deg").split() == [b"2", b"1", b"2", b"2", b"1"]


def test_adjacency_text_and_dumps(spark, tmp_path, graph):
    formats.write_adjacency_text(graph, str(tmp_path / "adj"))
    assert joined(tmp_path / "adj").decode().split() == "AdjacencyGraph 5 8 0 2 3 5 7 1 3 2 0 2 0 4 1".split()
    assigned = blocking.block_of_edges(graph, 3, 4)
    found = blocking.blocks(assigned, 3)
    formats.write_blocks(found, str(tmp_path / "blocks"))
    assert all(line.endswith(b" ") for line in joined(tmp_path / "blocks").splitlines())
    formats.write_block_edges(blocking.block_edges(assigned), blocking.block_index(found), str(tmp_path / "be"), str(tmp_path / "bi"))
    index = [int(x) for x in joined(tmp_path / "bi").split()]
    assert index[0] == 0 and index[-1] == 16 and index == sorted(index)
    assert joined(tmp_path / "be").splitlines()[0] == b"0 1"
    assert formats.shown_edges(assigned).first().value.startswith("#")
    assert formats.shown_blocks(found).orderBy("value").first().value.startswith("#1 (x:0, y:1)")


def test_results(tmp_path):
    for k in (1, 2):
        formats.append_result(str(tmp_path / "r.csv"), {"graph": "g", "ms": k})
    assert (tmp_path / "r.csv").read_text() == "graph,ms\ng,1\ng,2\n"


def test_place_of_bad_lines(spark, tmp_path):
    """Files of several splits: every line's number by plain counting."""
    folder, wanted = tmp_path / "raw", []
    folder.mkdir()
    for name, n in (("a.net", 5_000), ("b.net", 7), ("c.net", 0)):
        lines = [("bad %d" % i if i % 613 == 3 else "# no" if i % 7 == 5 else "" if i % 11 == 0 else f"{i} {i + 1}") for i in range(n)]
        (folder / name).write_text("".join(f"{line}\n" for line in lines))
        wanted += [(name, i + 1, line) for i, line in enumerate(lines) if line.startswith("bad")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        found = [(r.file.rpartition("/")[2], r.line, r.text) for r in sources.bad_lines(spark, str(folder)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(found) == sorted(wanted)


def test_csr_source_reads_only_the_range(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    from edgeloom.sources import binary

    edges = [(i % 50, j) for i in range(2_000) for j in ((i * 7) % 50, 3)] + [(17, j) for j in range(50)]
    graph = spark.createDataFrame(sorted(set(edges)), "src long, dst long")
    uri = str(tmp_path / "csr")
    formats.write_csr(graph, uri)
    binary.with_binary_sources(spark)

    def load(**options):
        return spark.read.format(binary.CSR).options(**options).load(uri)

    wanted = sorted(set(edges))
    assert pairs(load(chunk=13)) == wanted  # hubs are parted
    assert load(chunk=13).rdd.getNumPartitions() == -(-len(wanted) // 13)
    some = load(chunk=13).where("src >= 10 and src < 12 and dst > 20")
    assert pairs(some) == [e for e in wanted if 10 <= e[0] < 12 and e[1] > 20]
    assert pairs(load().where("src = 17")) == [e for e in wanted if e[0] == 17]
    assert load().where("src > 60").count() == 0 and load().where("src < 0").count() == 0
    read = []
    real = formats._Bytes.read
    monkeypatch.setattr(formats._Bytes, "read", lambda self, at, n: read.append((at, n)) or real(self, at, n))
    reader = binary.CsrReader(uri, False, False, 1_000)
    assert list(reader.pushFilters([GreaterThanOrEqual(("src",), 10), LessThan(("src",), 12), EqualTo(("dst",), 3)])) == [EqualTo(("dst",), 3)]
    rows = [(s, d) for p in reader.partitions() for b in reader.read(p) for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert rows == [e for e in wanted if 10 <= e[0] < 12]
    lists = 12 + 8 * (reader.n + 1)
    assert sum(n for at, n in read if at >= lists) == 4 * len(rows)


def test_a_failed_write_leaves_the_old_file(spark, tmp_path, graph):
    uri = tmp_path / "csr"
    big = spark.createDataFrame([(i % 40, (i * 3) % 40) for i in range(400)], "src long, dst long").distinct()
    formats.write_csr(big, str(uri), parts=6)
    before, size = joined(uri), big.count()
    fails = graph.select("src", F.when(F.col("dst") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("dst")).cast("long").alias("dst"))
    with pytest.raises(Exception):
        formats.write_csr(fails, str(uri))
    rows = graph.select(F.lit("u4").alias("kind"), F.when(F.col("dst") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("dst")).cast("long").alias("whole"), F.lit(None).cast("double").alias("real"))
    with pytest.raises(Exception):
        rows.write.format("edgeloom_bytes").mode("overwrite").save(str(uri))
    assert joined(uri) == before and formats.read_csr(spark, str(uri)).count() == size
    assert len([p for p in uri.iterdir() if p.is_dir()]) == 1  # the failed one's drafts are gone
    formats.write_csr(graph, str(uri), parts=2)  # and a smaller one leaves nothing of a larger one
    assert pairs(formats.read_csr(spark, str(uri))) == DENSE
    assert len([p for p in uri.iterdir() if p.is_dir()]) == 1
