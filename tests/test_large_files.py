"""Files of any size are read unless a bound is asked for."""

from scanframe.sources import files


def test_large_file_is_read_by_default(spark, tmp_path):
    size = (32 << 20) + 10
    (tmp_path / "big.py").write_text("x" * size)
    row = files.files_from_tree(spark, str(tmp_path)).selectExpr("length(content) AS n").first()
    assert row.n == size
    assert files.files_from_tree(spark, str(tmp_path), max_bytes=1000).first().content is None
