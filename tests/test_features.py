import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetsieve.operators.arrival import (
    inter_arrival_gaps,
    inter_arrival_moments,
    with_inter_arrival,
)
from packetsieve.operators.encoding import encode, fit_vocab
from packetsieve.operators.features import clean_packets, feature_matrix, stage_packets
from packetsieve.operators.ordering import ordered_index
from packetsieve.operators.scaling import fit_scaler, scale, scaler_constants
from packetsieve.schema import CATEGORICAL, FEATURES, NUMERIC, ROW_ID, STORED_NUMERIC, TIMESTAMP


def times_frame(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, t string")
    return df.select(ROW_ID, F.col("t").try_cast("timestamp_ntz").alias(TIMESTAMP))


def expected_iat(texts):
    times = pd.to_datetime(pd.Series(texts, dtype=object), errors="coerce", format="ISO8601")
    ordered = times.sort_values(kind="stable")
    return ordered.diff().dt.total_seconds().fillna(0).sort_index().tolist()


@pytest.mark.parametrize(
    "texts",
    [
        [],
        ["2024-01-01 00:00:00"],
        ["bad", None],
        ["2024-01-01 00:00:01", "2024-01-01 00:00:00", "bad", "2024-01-01 00:00:01"],
        ["2024-01-03 00:00:00", "2024-01-01 23:59:59.999999", "2024-01-01 23:59:59.5", "1969-12-31 23:59:58.25"],
        ["2024-01-01 00:00:00"] * 50,
    ],
)
def test_inter_arrival_edges(spark, texts):
    df = times_frame(spark, texts)
    rows = with_inter_arrival(df).orderBy(ROW_ID).collect()
    assert [r["iat"] for r in rows] == pytest.approx(expected_iat(texts), abs=1e-6)
    moments = inter_arrival_moments(df, inter_arrival_gaps(df)).first()
    assert moments["n"] == len(texts)
    if texts:
        want = np.array(expected_iat(texts))
        assert moments["mean"] == pytest.approx(want.mean())
        assert moments["deviation"] == pytest.approx(want.std())
        assert moments["maximum"] == pytest.approx(want.max())


def test_inter_arrival_of_many_rows(spark):
    rng = np.random.default_rng(3)
    start = pd.Timestamp("2024-01-01")
    offsets = np.concatenate([rng.integers(0, 3 * 86400 * 10**6, 1500), np.full(700, 4242)])
    rng.shuffle(offsets)
    texts = [str(start + pd.Timedelta(int(o), unit="us")) for o in offsets]
    df = times_frame(spark, texts).repartition(7)
    rows = with_inter_arrival(df).orderBy(ROW_ID).collect()
    assert [r["iat"] for r in rows] == pytest.approx(expected_iat(texts), abs=1e-6)


def test_staged_copies_get_ids_of_their_own(spark, packet_rows):
    base = packet_rows(40).drop(ROW_ID)
    copies = base.unionByName(base).unionByName(base)
    staged = stage_packets(copies)
    assert staged.select(ROW_ID).distinct().count() == 120
    single = stage_packets(base)
    total = with_inter_arrival(staged).agg(F.sum("iat")).first()[0]
    assert total == pytest.approx(with_inter_arrival(single).agg(F.sum("iat")).first()[0])


@pytest.mark.parametrize("parts", [1, 8])
def test_ordered_index(spark, parts):
    values = np.random.default_rng(1).permutation(500).tolist()
    df = spark.createDataFrame([(int(v), "same") for v in values], "v long, s string")
    got = ordered_index(df.repartition(parts), [F.col("s").asc(), F.col("v").asc()])
    assert {(r["v"], r["position"]) for r in got.collect()} == {(i, i) for i in range(500)}


def test_vocab_sorts_by_code_point(spark):
    values = ["b", "B", "a", "é", "z", "10", "9", "__NA__", "Ω", "😀", "ﬀ"]
    df = spark.createDataFrame([(v, "x") for v in values * 3], "ip_src string, ip_dst string")
    rows = fit_vocab(df, ["ip_src", "ip_dst"]).collect()
    codes = {(r["col"], r["value"]): r["code"] for r in rows}
    assert [codes["ip_src", v] for v in sorted(values)] == list(range(len(values)))
    assert codes["ip_dst", "x"] == 0.0
    assert {r["frequency"] for r in rows if r["col"] == "ip_src"} == {3}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_encode_broadcast_and_shuffled(spark, packet_rows, limit):
    rows = clean_packets(packet_rows(400), keep=[ROW_ID])
    vocab = fit_vocab(rows.where(F.col(ROW_ID) < 100))
    known = {(r["col"], r["value"]): r["code"] for r in vocab.collect()}
    got = {r[ROW_ID]: r for r in encode(rows, vocab, broadcast_bytes=limit).collect()}
    want = rows.collect()
    assert len(got) == len(want) == 400
    for r in want:
        for c in CATEGORICAL:
            assert got[r[ROW_ID]][c] == known.get((c, r[c]), -1.0)


def test_shuffled_encode_with_hot_and_unseen_values(spark):
    train = spark.createDataFrame([(f"v{i}",) for i in range(2500)] + [("hot",)] * 5000, "ip_src string")
    vocab = fit_vocab(train, ["ip_src"])
    values = ["hot"] * 300 + ["unseen"] * 300 + [f"v{i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), f"{ROW_ID} long, ip_src string")
    codes = {r["value"]: r["code"] for r in vocab.collect()}
    got = encode(df, vocab, ["ip_src"], broadcast_bytes=0).collect()
    assert len(got) == 900
    assert all(r["ip_src"] == codes.get(values[r[ROW_ID]], -1.0) for r in got)


def test_scaler(spark):
    data = [(i, float(i % 2), 5.0) for i in range(4)]
    df = spark.createDataFrame(data, f"{ROW_ID} long, frame_len double, tcp_srcport double")
    rest = [c for c in STORED_NUMERIC if c not in ("frame_len", "tcp_srcport")]
    df = df.withColumns({c: F.lit(0.0) for c in rest}).withColumn(
        TIMESTAMP, F.lit("2024-01-01").cast("timestamp_ntz")
    )
    constants = scaler_constants(fit_scaler(df, inter_arrival_gaps(df)))
    assert constants["frame_len"] == (0.5, 0.5)
    assert constants["tcp_srcport"] == (5.0, 1.0)
    assert constants["iat"] == (0.0, 1.0)
    scaled = scale(df, constants, ["frame_len", "tcp_srcport"]).orderBy(ROW_ID).collect()
    assert [(r["frame_len"], r["tcp_srcport"]) for r in scaled] == [(-1.0, 0.0), (1.0, 0.0)] * 2


@pytest.mark.parametrize("parts", [1, 8])
def test_feature_matrix_against_pandas(spark, packet_rows, parts):
    raw = packet_rows(300, seed=5)
    rows = clean_packets(raw.repartition(parts), keep=[ROW_ID])
    gaps = inter_arrival_gaps(rows)
    vocab, scaler = fit_vocab(rows), fit_scaler(rows, gaps)
    got = feature_matrix(rows, vocab, scaler, gaps).toPandas().sort_values(ROW_ID)
    assert list(got.columns) == [ROW_ID, *FEATURES]

    pdf = raw.toPandas().sort_values(ROW_ID)
    pdf["iat"] = expected_iat(pdf[TIMESTAMP].tolist())
    for c in CATEGORICAL:
        text = pdf[c].fillna("NA" if c == "tcp_flags" else "__NA__")
        codes = {v: i for i, v in enumerate(sorted(text.unique()))}
        assert got[c].tolist() == [codes[v] for v in text]
    for c in NUMERIC:
        x = pd.to_numeric(pdf[c], errors="coerce").fillna(0.0).to_numpy(float)
        want = (x - x.mean()) / (x.std() or 1.0)
        assert np.allclose(got[c].to_numpy(), want, atol=1e-9)
