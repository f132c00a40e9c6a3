import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyfold.llm.scratch import FILE_ROWS, Scratch

PARTITIONS = 40


@pytest.fixture
def spread(spark):
    """Spark leaves all of many shuffle partitions as they are."""
    settings = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def test_files_follow_the_rows_where_they_are_known(spread):
    many = spread.range(1000).repartition(PARTITIONS, "id")
    scratch = Scratch(spread)
    for rows, files in ((1000, 1), (0, 1), (5 * FILE_ROWS + 1, 6), (None, PARTITIONS)):
        table = scratch.write(many, rows)
        assert len(table.inputFiles()) == files
        assert table.agg(F.count("*"), F.sum("id")).first() == (1000, 499_500)


@pytest.mark.parametrize("at", range(4))
def test_few_rows_of_a_stage_are_few_files(spread, docs, tmp_path, monkeypatch, at):
    benchmark = [(i, " ".join(f"q{i}w{j}" for j in range(20))) for i in range(30)]
    spread.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [f"write to a{i}.b@mail{i}.org about it, " + " ".join(f"word{i * j % 97}x{i}" for j in range(30)) for i in range(60)]
    rows += [r + " more" for r in rows] + [text for _, text in benchmark]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    written, write = [], Scratch.write

    def noted(self, *args):
        table = write(self, *args)
        written.append((len(table.inputFiles()), table.columns))
        return table

    monkeypatch.setattr(Scratch, "write", noted)
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spread, spread.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert out.count() > 0, name
    assert written and max(written)[0] <= 3, (name, written)
