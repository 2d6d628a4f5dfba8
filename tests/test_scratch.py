from pathlib import Path

from sheaf.scratch import clean, scratch_path, written


def test_written_tables_and_their_removal(spark):
    df = written(spark.range(5), "five")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    assert any(folder.iterdir())
    clean(spark)
    assert not folder.exists()
