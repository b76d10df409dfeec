import pytest


@pytest.fixture()
def docs(spark):
    """Rows with every odd thing: nulls, blanks, copies, ties, repeated rows, long texts, clashing names of columns."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string"):
        wide = [(*r, *[None] * (7 - len(r))) for r in rows]
        return spark.createDataFrame(wide, schema)

    return make


@pytest.fixture()
def folder(tmp_path, docs, spark):
    """A folder of tables: documents and labels from rows."""

    def make(rows, labels=(), pages=()):
        docs(rows).write.mode("overwrite").parquet(f"{tmp_path}/t/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/t/labels.parquet")
        spark.createDataFrame(list(pages), "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/t/pages.parquet")
        return f"{tmp_path}/t"

    return make
