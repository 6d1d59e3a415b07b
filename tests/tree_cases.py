"""Small tables that several tests build."""

SF = "/root/testdata/sf0.001"


def make_files(spark, files: dict[str, str]):
    """path → text as a ``files`` table."""
    rows = [(path, bytearray(text.encode())) for path, text in files.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def pairs(df) -> set[tuple[str, str]]:
    return {(row.source, row.target) for row in df.select("source", "target").collect()}
