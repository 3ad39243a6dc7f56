"""The pipeline's result against its stages done plainly, and the guard of the entry module."""

import pathlib
import random
import subprocess
import sys
from array import array
from collections import Counter, defaultdict

from tests.llm.conftest import SCHEMA, sentence
from tests.llm.test_operators import plain_groups, plain_repeats, plain_verdicts, plain_words, whole_ids

import corpus_pipeline
from edgeloom.llm import packing


def plain_run(rows, items):
    """Ids and texts that reach the packing."""
    rows = [r for r, (_, kept) in zip(rows, plain_verdicts([t for _, t in rows])) if kept]
    group, least = plain_groups([t for _, t in rows]), {}
    for i, t in rows:
        least[group[t]] = min(i, least.get(group[t], i))
    rows = [(i, t) for i, t in rows if least[group[t]] == i]
    rows = [(i, kept.decode()) for i, kept, _, _ in plain_repeats(rows, 200, True)]
    windows = {tuple(w[p : p + 10]) for w in map(plain_words, items) for p in range(len(w) - 9)}
    hit = lambda w: any(tuple(w[p : p + 10]) in windows for p in range(len(w) - 9))
    return [(i, t) for i, t in rows if not hit(plain_words(t))]


def test_run(spark, tmp_path):
    pick = random.Random(11)
    passage = sentence(pick, 110)
    items = [sentence(pick, 20) for _ in range(3)]
    texts = [sentence(pick, pick.randrange(60, 200)) for _ in range(60)]
    texts += texts[:5] + [t + " more" for t in texts[5:8]] + [f"{sentence(pick, 40)} {passage} {sentence(pick, 60)}" for _ in range(3)]
    texts += [f"{sentence(pick, 40)} {item.title()} {sentence(pick, 40)}" for item in items] + ["word " * 80, "too short", None, "", sentence(pick, 3000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces, sequences = defaultdict(list), Counter()
    for r in found:
        pieces[r.doc_id].append((r.piece, bytes(r.ids)))
        sequences[r.sequence_id] += r.length
    want = {i: array("I", [*whole_ids(t), packing.END_ID]).tobytes() for i, t in plain_run([r[:2] for r in rows], items)}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == want
    assert len(want) < len(texts) - 10 and max(sequences.values()) <= 1024


def test_run_of_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_its_last_table_only(spark, docs, tmp_path):
    from edgeloom import shared

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    root = pathlib.Path(shared.shared_root(spark).removeprefix("file://"))
    before = {p.name for p in root.iterdir()} if root.exists() else set()
    corpus_pipeline.run(spark, str(tmp_path)).count()
    left = sorted(p.name.split("-")[1] for p in root.iterdir() if p.name not in before)
    assert left == ["counts", "decontamination", "pieces"]


def test_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = docs.drop("words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.dtypes == frame.dtypes, name
        out.count()
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0


def test_entry_without_this_part():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('edgeloom.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'pagerank_10' in e.queries() and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
