import csv
import io
import json

import pytest

from quorumtab.functions import table_function
from quorumtab.sources import caches


def test_stored_samples_and_skeletons(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "k1.json").write_text(json.dumps([{"csv_data": "a\tb", "input_tokens": 3, "output_tokens": 4}, {"csv_data": None, "input_tokens": 0, "output_tokens": 0}], indent=2))
    (tmp_path / "s" / "k2.json").write_text("{broken")
    got = [tuple(r) for r in caches.read_samples(spark, str(tmp_path / "s")).orderBy("sample_idx").collect()]
    assert got == [("k1", 0, "a\tb", 3, 4), ("k1", 1, None, 0, 0)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "new.json").write_text('{"structure": "x"}')
    (tmp_path / "t" / "old.json").write_text('[{"structure": "y"}]')
    assert sorted(tuple(r) for r in caches.read_skeletons(spark, str(tmp_path / "t")).collect()) == [("new", "x"), ("old", "y")]


def test_samples_written_are_read_back(spark, tmp_path):
    rows = [("k 1/é+%", 1, 'a\t"b"\nc\t1', 3, 4), ("k 1/é+%", 0, None, 0, None), ("7", 0, "", 1, 2)]
    samples = spark.createDataFrame(rows, "image_id string, sample_idx int, tsv_data string, input_tokens long, output_tokens long")
    caches.write_samples(samples, str(tmp_path / "w"))
    assert sorted(map(tuple, caches.read_samples(spark, str(tmp_path / "w")).collect()), key=str) == sorted(rows, key=str)


def test_next_samples(spark):
    stored = spark.createDataFrame([("a", i, f"t{i}") for i in range(3)], "image_id string, sample_idx int, tsv_data string")
    cursors = spark.createDataFrame([("a", 1), ("b", 0)], "image_id string, next_idx int")
    got = sorted(map(tuple, caches.next_samples(stored, cursors, 3).collect()))
    assert got == [("a", 1, "t1", True), ("a", 2, "t2", True), ("a", 3, None, False), ("b", 0, None, False), ("b", 1, None, False), ("b", 2, None, False)]


def test_series(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Series,Code,Country,CC,2000 [YR2000],2001 [YR2001]\nGDP,x,A,a,1.5,..\nGDP,x,B,b,,7\nGDP,x,B,b,3,8\n")
    got = sorted(tuple(r) for r in caches.read_series(spark, str(tmp_path / "w.csv")).collect())
    assert got == [("GDP", "A", 2000, 1.5), ("GDP", "A", 2001, None), ("GDP", "B", 2000, 3.0), ("GDP", "B", 2001, 8.0)]


HEAD = "Series,Code,Country,CC,2000 [YR2000],2001 [YR2001],2002 [YR2002]\n"


def plain(text):
    """The rows as csv.reader has them, the last of each series and country."""
    reader = csv.reader(io.StringIO(text, newline=""))
    years = [int(c.split()[0]) for c in next(reader)[4:]]
    rows = {(r[0], r[2]): {y: None if v in ("", "..") else float(v) for y, v in zip(years, r[4:])} for r in reader}
    return sorted(((s, c, y, v) for (s, c), values in rows.items() for y, v in values.items()), key=str)


@pytest.mark.parametrize("body", [
    '"A ""q"", b",C,X,XY,1.5,..,3\n', '"two\nlines\r\nmore",C,"X, Y",XY,1,,"2"\n', "A,C,X,XY,1\nA,C,Y,XY,1,2,3,4,5\nB,C,X,XY\n", "A,C,X,XY,1,2,3\nA,C,X,XY,7,8\n",
    'A b"c,C,X\ty,é,1e5, 2 ,-inf\n', "",
])
def test_series_as_csv_reader(spark, tmp_path, body):
    """Doubled quotes, line breaks in fields, short and long rows, repeated rows, odd numbers."""
    (tmp_path / "w.csv").write_text(HEAD + body, newline="")
    got = sorted((tuple(r) for r in caches.read_series(spark, str(tmp_path / "w.csv")).collect()), key=str)
    assert got == plain(HEAD + body)


def test_series_errors_have_their_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + 'A,C,X,XY,1,2,3\n"B\n",C,X,XY,1,n/a,3\nA,C\n')
    (tmp_path / "b.csv").write_text(HEAD + "A,C,Z,XY,1,2,1.5d\n")
    got = sorted((r.file.split("/")[-1], r.row, r.year, r.broken) for r in caches.series_errors(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 2, 2001, "not a number: n/a"), ("a.csv", 3, None, "too few fields"), ("b.csv", 1, 2002, "not a number: 1.5d")]
    with pytest.raises(Exception, match="a.csv"):
        caches.read_series(spark, str(tmp_path / "a.csv")).collect()


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [bytes(r.content) for r in caches.read_images(spark, str(tmp_path)).collect()] == [b"abc"]


def test_table_function_refuses_other_dialects(spark):
    table_function.register(spark)
    one = "SELECT count(*) AS n FROM VALUES ('a\\tb\\nc\\t1'), (CAST(NULL AS STRING)), ('') t(x), LATERAL table_cells(x, '{}')"
    assert spark.sql(one.format("plain")).first().n == 1
    with pytest.raises(Exception, match="dialects"):
        spark.sql(one.format("yaml")).collect()
