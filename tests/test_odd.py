"""Registered queries on odd tables, against their DuckDB twins."""

import duckdb
import pandas as pd

from tests.conftest import same
from timeloom.plans import catalog


def check(spark, tmp_path, name, **tables):
    """The query and its twin over the same small tables, given as pandas frames."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    same(got, con.execute(catalog.ORACLES[name]).df())
    return got


def test_descriptions_in_odd_letters(spark, tmp_path):
    """Letters whose full upper case is longer, white space that only one engine counts as such, lines that end without a line feed."""
    texts = [f"{c}abc. {c} Overall, the mood{c}x.{c}The text on the image read{c} says{c}b. It is {c}{c}x" for c in "ßk\u0149\u1f80\ufb01\u01c6\x0b\x85\u2028\u2029\xa0\u3000\u017f\u212a\u0131\u0130éÉ\U00010428_1"]
    texts += ["a still. \xa0\u00dfx \u3000", " \u1f80x", "x a scene. The image is from a movie\u2028", "The \u0131mage \u017fhow\u017f \u00dfen.", "a\x01\x01b", "", None, "\r\n", "x is written in white text\x85 y"]
    texts += [f"from a movie. {t}" for t in texts if t]
    check(spark, tmp_path, "clean_description", documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))


def events(values, at=lambda k: k * 3_600_000):
    """Events of two users."""
    n = len(values)
    ts = pd.Series([pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=at(k // 2)) for k in range(n)]).astype("datetime64[us]")
    return pd.DataFrame({"event_id": range(n), "ts": ts, "user_id": [k % 2 for k in range(n)], "event_type": "view", "value": [float(v) for v in values], "props": "{}"})


def test_rows_of_no_length_at_the_beginning_are_owned(spark, tmp_path):
    got = check(spark, tmp_path, "midpoint_ownership", events=events([0, 0, 0, 5, 0, -0.5] + [30, 0.0] * 60))
    assert len(got) == 126 and set(got[got.row_id < 2].chunk_id) == {"chunk_0000"}


#: Values whose confidences lie halfway between two places, three times each.
HALVES = [1.5 + 3 * (k // 3) for k in range(330)] + [0, 120, 150, 300]


def test_profiles_round_as_doubles_do(spark, tmp_path):
    got = check(spark, tmp_path, "profile_json", events=events(HALVES)).set_index("id").war
    assert (got[HALVES.index(43.5)], got[HALVES.index(172.5)], got[HALVES.index(100.5)]) == (0.14, 0.57, 0.34)


def test_scenes_round_as_doubles_do(spark, tmp_path):
    got = check(spark, tmp_path, "scene_json", events=events(HALVES)).set_index("id").fight
    assert got[HALVES.index(55.5)] == 0.09  # 55.5 / 300 - 0.1 is just below 0.085, times 100 it is 8.5
