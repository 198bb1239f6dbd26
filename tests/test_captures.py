import pytest
from pyspark.sql import functions as F

from packetsieve.operators.features import clean_packets
from packetsieve.schema import RAW_COLUMNS
from packetsieve.sources import captures
from packetsieve.sources.captures import (
    captures_in_range,
    list_captures,
    prune_lenient,
    prune_strict,
    read_captures,
    training_captures,
)


def write(folder, name, header, *rows):
    lines = [",".join(header), *[",".join(r) for r in rows]]
    (folder / name).write_text("\n".join(lines) + "\n")


def row(columns, **values):
    return [values.get(c, "v") for c in columns]


@pytest.fixture
def folder(tmp_path):
    normal = list(RAW_COLUMNS)
    turned = normal[::-1]
    extra = [*normal, "comment"]
    short = [c for c in normal if c != "udp_srcport"]
    write(tmp_path, "a_2024-01-01_x.csv", normal, row(normal, ip_src="one", frame_len="60"))
    write(tmp_path, "a_2024-01-02_x.csv", turned, row(turned, ip_src="two", frame_len="61"))
    write(tmp_path, "a_2024-01-03_x.csv", extra, row(extra, ip_src="three", frame_len="62"))
    write(tmp_path, "a_2024-01-04_x.csv", short, row(short, ip_src="four", frame_len="63"))
    return tmp_path


def test_columns_keep_their_names(spark, folder):
    rows = read_captures(spark, list_captures(spark, f"{folder}/*.csv"))
    got = {r["ip_src"]: r for r in rows.collect()}
    assert {k: v["frame_len"] for k, v in got.items()} == {
        "one": "60", "two": "61", "three": "62", "four": "63"
    }
    assert got["four"]["udp_srcport"] is None and got["one"]["udp_srcport"] == "v"
    assert got["three"]["comment"] == "v" and got["one"]["comment"] is None
    assert got["two"]["file_name"] == "a_2024-01-02_x.csv"


def test_same_header_is_checked(spark, folder):
    files = list_captures(spark, f"{folder}/*.csv")
    with pytest.raises(Exception, match="(?i)header"):
        read_captures(spark, files, same_header=True).collect()
    first = files.where(F.col("file_name") == "a_2024-01-01_x.csv")
    assert read_captures(spark, first, same_header=True).count() == 1


def test_null_spellings(spark, tmp_path):
    texts = ['""', "NA", "N/A", "null", "None", "NaN", "", "-", "na", '"a,b"', '"say ""x"""']
    write(tmp_path, "c.csv", ["k", "v"], *[[str(i), t] for i, t in enumerate(texts)])
    rows = read_captures(spark, list_captures(spark, f"{tmp_path}/c.csv")).collect()
    got = {int(r["k"]): r["v"] for r in rows}
    assert [got[i] for i in range(7)] == [None] * 7
    assert [got[i] for i in range(7, 11)] == ["-", "na", "a,b", 'say "x"']


def test_strict_dates(spark, folder):
    files = list_captures(spark, f"{folder}/*.csv")
    assert prune_strict(files, "2024-01-02", "2024-01-03").count() == 2
    assert prune_strict(files, start="2024-01-03").count() == 2
    assert prune_strict(files, end="2024-01-01").count() == 1
    (folder / "noparts.csv").write_text("a\n1\n")
    files = list_captures(spark, f"{folder}/*.csv")
    assert prune_strict(files).count() == 5
    with pytest.raises(Exception, match="no date in capture name"):
        prune_strict(files, start="2024-01-01").collect()


def test_lenient_dates_and_bad_files(spark, folder):
    (folder / "noparts.csv").write_text("a\n1\n")
    (folder / "x_2024-01-02.csv").write_text("")
    files = list_captures(spark, f"{folder}/*.csv")
    kept = prune_lenient(files, "2024-01-02", "2024-01-04").select("file_name").collect()
    assert "noparts.csv" not in {r[0] for r in kept}
    assert captures_in_range(spark, f"{folder}/*.csv", "2024-01-02", "2024-01-04").count() == 3


def test_empty_input(spark, folder):
    assert training_captures(spark, f"{folder}/*.csv", "2030-01-01", "2030-01-02") is None
    with pytest.raises(FileNotFoundError):
        captures_in_range(spark, f"{folder}/*.csv", "2030-01-01", "2030-01-02")
    (folder / "a_2025-01-01_x.csv").write_text(",".join(RAW_COLUMNS) + "\n")
    assert training_captures(spark, f"{folder}/*.csv", "2025-01-01", "2025-01-01") is None


def test_odd_names_broken_records_and_line_breaks(spark, tmp_path):
    header = list(RAW_COLUMNS)
    good = row(header, ip_src="good")
    write(tmp_path, "a b%20c_2024-01-01_x 5%.csv", header, good, good[:5])
    write(tmp_path, "long_2024-01-02_x.csv", header, good, [*good, "more"], good)
    write(tmp_path, "quoted_2024-01-03_x.csv", header, row(header, ip_src='"two\nlines"'), good)
    ranged = captures_in_range(spark, f"{tmp_path}/*.csv", "2024-01-01", "2024-01-03")
    rows = ranged.collect()
    assert ranged.count() == len(rows) == 2
    assert {r["file_name"] for r in rows} == {"a b%20c_2024-01-01_x 5%.csv"}
    for day in ("02", "03"):
        with pytest.raises(Exception, match="does not fit the header"):
            training_captures(spark, f"{tmp_path}/*.csv", f"2024-01-{day}", f"2024-01-{day}").collect()
    whole = training_captures(
        spark, f"{tmp_path}/*.csv", "2024-01-03", "2024-01-03", multi_line=True
    )
    assert sorted(r["ip_src"] for r in whole.collect()) == ["good", "two\nlines"]


def test_another_header_fails_also_in_scoring(spark, folder):
    with pytest.raises(Exception, match="(?i)header"):
        captures_in_range(
            spark, f"{folder}/*.csv", "2024-01-01", "2024-01-04", same_header=True
        ).collect()


def test_required_columns(spark):
    columns = [c for c in RAW_COLUMNS if c != "timestamp"]
    df = spark.createDataFrame([["v"] * len(columns)], columns)
    with pytest.raises(ValueError, match="timestamp"):
        clean_packets(df)


def test_missing_numeric_columns_are_zero(spark):
    columns = [c for c in RAW_COLUMNS if c != "udp_srcport"]
    df = spark.createDataFrame([["7"] * len(columns)], columns)
    got = clean_packets(df).first()
    assert got["udp_srcport"] == 0.0 and got["frame_len"] == 7.0


@pytest.fixture
def no_driver_reads(monkeypatch):
    def refuse(*_):
        raise AssertionError("a file was opened from the driver")

    monkeypatch.setattr(captures, "_line_on_driver", refuse)


def test_thousands_of_files_are_opened_in_tasks(spark, tmp_path, no_driver_reads):
    for i in range(3000):
        header = ["k", "v"] if i % 3 else ["v", "k"]
        write(tmp_path, f"f{i}.csv", header, [str(i), "x"] if i % 3 else ["x", str(i)])
    rows = read_captures(spark, list_captures(spark, f"{tmp_path}/*.csv"))
    got = rows.agg(F.count("*"), F.sum(F.col("k").cast("long")), F.count_distinct("v"), F.count_distinct("file_name")).first()
    assert tuple(got) == (3000, 3000 * 2999 // 2, 1, 3000)


def test_many_headers_are_one_scan(spark, tmp_path, no_driver_reads):
    want = {}
    for i in range(200):
        header = [f"c{j}" for j in range(i % 7 + 1)] + [f"own{i}", "k"]
        header = header[::-1] if i % 2 else header
        write(tmp_path, f"f{i:03d}.csv", header, row(header, k=str(i), **{f"own{i}": f"o{i}"}), row(header, k=str(i))[: len(header) - 1])
        want[f"f{i:03d}.csv"] = header
    files = list_captures(spark, f"{tmp_path}/*.csv")
    rows = read_captures(spark, files, skip_bad=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    assert rows.columns == list(dict.fromkeys(n for h in want.values() for n in h)) + ["file_name"]
    got = rows.collect()
    assert len(got) == 400
    for r in got:
        header = want[r["file_name"]]
        assert all(r[c] is None for c in rows.columns if c not in header and c != "file_name")
        assert r[header[0]] is not None
    full = [r for r in got if r[want[r["file_name"]][-1]] is not None]
    assert len(full) == 200 and all(r["k"] == str(int(r["file_name"][1:4])) for r in full)
    # Records longer than their own header but not than the widest one are broken.
    write(tmp_path, "g.csv", ["k", "own7"], ["1", "2", "3"])
    for i, extra in enumerate((7, 8)):
        write(tmp_path, f"h{i}.csv", ["k", "c0"], ["v"] * (extra + 2))
    files = list_captures(spark, f"{tmp_path}/*.csv")
    with pytest.raises(Exception, match="does not fit the header"):
        read_captures(spark, files).collect()
    kept = read_captures(spark, files, skip_bad=True)
    assert {r["file_name"] for r in kept.select("file_name").distinct().collect()} == set(want)


def test_files_that_cannot_be_opened(spark, tmp_path):
    write(tmp_path, "a.csv", ["k"], ["1"])
    write(tmp_path, "b.csv", ["k"], ["2"])
    files = list_captures(spark, f"{tmp_path}/*.csv").collect()
    files = spark.createDataFrame(files)
    (tmp_path / "b.csv").unlink()
    assert read_captures(spark, files, skip_bad=True).count() == 1
    with pytest.raises(OSError, match="b.csv"):
        read_captures(spark, files)


def test_headers_of_a_store_that_only_spark_reads(spark, folder, monkeypatch):
    files = list_captures(spark, f"{folder}/*.csv")
    want = {r["path"]: r["header"] for r in captures.header_table(files).collect()}
    got = {r["path"]: r["header"] for r in captures._headers_on_driver(spark, files).collect()}
    assert got == want and len(got) == 4
    monkeypatch.setattr(captures, "_is_known_store", lambda uri: False)
    assert read_captures(spark, files).count() == 4


def test_a_pruned_read_knows_the_kept_paths_only(spark, folder, no_driver_reads):
    files = prune_lenient(list_captures(spark, f"{folder}/*.csv"), "2024-01-02", "2024-01-03")
    layout = captures.layout_of(spark, files, skip_bad=True, same_header=False)
    assert [p.rsplit("/", 1)[-1] for p in layout.paths] == ["a_2024-01-02_x.csv", "a_2024-01-03_x.csv"]
    assert layout.table.count() == 2 and sorted(layout.files) == [1, 1]


def test_rows_are_not_dealt_by_their_header(spark, folder):
    """A join on the header would put all rows of the usual one in one task."""
    rows = read_captures(spark, list_captures(spark, f"{folder}/*.csv"))
    assert sorted(r["ip_src"] for r in rows.collect()) == ["four", "one", "three", "two"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
