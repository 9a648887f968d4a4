import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from docflow.sources import page_source as S


class LockedPages:
    """Lines of a file are pages, once the first one is given as the password."""

    def ranges(self, file, password, size):
        return [S.Range()]

    def pages(self, file, password, part):
        secret, *pages = file.read().decode().split("\n")
        if secret != (password or ""):
            raise S.Locked
        for k, text in enumerate(pages):
            if text == "broken":
                raise ValueError("broken page")
            yield k + 1, len(pages), text


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("one\fzwei ü\f\fvier")
    (tmp_path / "big.txt").write_text("\f".join(f"page {i} " + "x" * (i % 50) for i in range(1, 501)))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.lok").write_text("secret\nfirst\nsecond")
    (tmp_path / "d.lok").write_text("\nfirst\nbroken")
    (tmp_path / "skip").mkdir()
    return str(tmp_path)


def read(spark, folder, **options):
    S.register(spark)
    return spark.read.format("docflow_pages").options(path=folder, **{"decoder.lok": "tests.test_page_source:LockedPages"} | options).load()


def rows(df, name):
    return sorted(((r.page, r.total, r.text, r.error) for r in df.collect() if r.document_id == name), key=repr)


@pytest.mark.parametrize("size", ["67108864", "700", "1"])
def test_pages(spark, folder, size):
    df = read(spark, folder, rangeBytes=size)
    assert rows(df, "a.txt") == [(1, 4, "one", None), (2, 4, "zwei ü", None), (3, 4, "", None), (4, 4, "vier", None)]
    assert sorted(rows(df, "big.txt")) == [(i, 500, f"page {i} " + "x" * (i % 50), None) for i in range(1, 501)]
    assert rows(df, "empty.txt") == [(1, 1, "", None)]
    assert rows(df, "b.pdf") == [(None, None, None, S.FAILED)]
    assert rows(df, "skip") == []


def test_passwords_and_broken_files(spark, folder):
    df = read(spark, folder)
    assert rows(df, "c.lok") == [(None, None, None, S.LOCKED)]
    # Pages before the fault stay, and the error is said.
    assert rows(df, "d.lok") == [(1, 2, "first", None), (None, None, None, S.FAILED)]
    assert rows(read(spark, folder, password="secret"), "c.lok") == [(1, 2, "first", None), (2, 2, "second", None)]
    assert rows(read(spark, folder, password="other"), "c.lok") == [(None, None, None, S.LOCKED)]


def test_filters_choose_files_and_ranges(spark, folder):
    reader = S.PageReader({"path": folder, "rangeBytes": "700"})
    every = reader.partitions()
    assert len([p for p in every if p.path.endswith("big.txt")]) > 20
    other = StringContains(("text",), "x")
    assert list(reader.pushFilters([EqualTo(("document_id",), "big.txt"), GreaterThan(("page",), 100), LessThanOrEqual(("page",), 120), other])) == [other]
    parts = reader.partitions()
    assert 1 <= len(parts) <= 3 and all(p.path.endswith("big.txt") and p.part.last >= 101 and p.part.first <= 120 for p in parts)
    # Ranges follow each other, by page and by byte.
    whole = [p.part for p in every if p.path.endswith("big.txt")]
    assert whole[0].first == 1 and whole[-1].last == 500 and all(a.last + 1 == b.first and a.end + 1 == b.start for a, b in zip(whole, whole[1:], strict=False))
    none = S.PageReader({"path": folder})
    assert list(none.pushFilters([In(("document_id",), ("a.txt", "z")), EqualTo(("document_id",), "big.txt")])) == [] and none.partitions() == []


def test_filters_through_spark(spark, folder):
    df = read(spark, folder, rangeBytes="700")
    asked = df.where("document_id = 'big.txt' and page between 101 and 120 and text like 'page 1%'")
    assert sorted(r.page for r in asked.collect()) == list(range(101, 121))
    assert asked.rdd.getNumPartitions() <= 3
    assert df.where("page = 4").select("document_id").distinct().count() == 2
    assert sorted(r.document_id for r in df.where("page is null").collect()) == ["b.pdf", "c.lok", "d.lok"]
    assert df.where("page > 2 and page < 2").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert spark.read.format("docflow_pages").options(path=folder, pushdown="false").load().where(F.col("page") == 4).count() == 2


def test_one_file_patterns_and_missing_path(spark, folder):
    assert read(spark, f"{folder}/a.txt").count() == 4
    assert read(spark, f"{folder}/*.pdf").count() == 1
    with pytest.raises(Exception, match="nothing-here"):
        read(spark, f"{folder}/nothing-here").count()
    with pytest.raises(Exception, match="path is required"):
        spark.read.format("docflow_pages").load().count()
