from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import instruments as IN

MAPPED = (
    "symbol string, ticker string, exchange_code string, security_type_2 string, share_class_id string, "
    "composite_id string, name string, at long"
)
A, B, C = "BBG000000001", "BBG000000002", "BBG00000000C"


def resolve(spark, roster, rows):
    frame = spark.createDataFrame(rows, MAPPED)
    asked = spark.createDataFrame([(s,) for s in roster], "symbol string")
    out = IN.resolve_instruments(asked, frame, IN.is_mapped_listing(), "share_class_id", ["name"], "at")
    return {r["symbol"]: r for r in out.collect()}


def test_none_one_two_and_blank(spark):
    good = ("US", "Common Stock")
    rows = [
        ("bf-b", "BF/B", *good, A, C, "old", 1),
        ("BF-B", "BF/B", *good, A, C, " Brown ", 2),  # the same identifier again: still one, last details
        ("TWO", "TWO", *good, A, C, "x", 1),
        ("TWO", "TWO", *good, B, C, "y", 2),
        ("BLANK", "BLANK", *good, A, C, "  ", 1),
        ("NOPE", "NOPE", "LN", "Common Stock", A, C, "x", 1),
        ("NOPE", "NOPE", "US", "Warrant", A, C, "x", 2),
        ("NOPE", "NOP", *good, A, C, "x", 3),
        ("NOPE", "NOPE", *good, A.lower(), C, "x", 4),
        ("NOPE", "NOPE", *good, A, C + "0", "x", 5),
        ("NOPE", "NOPE", *good, A + "\n", C, "x", 6),
        ("NOPE", "NOPE", *good, None, C, "x", 7),
        (None, None, None, None, None, None, None, 8),
    ]
    got = resolve(spark, [" BF-B", "bf-b", "TWO", "BLANK", "NOPE", "UNASKED", None], rows)
    assert set(got) == {"BF-B", "TWO", "BLANK", "NOPE", "UNASKED"}
    assert (got["BF-B"]["status"], got["BF-B"]["share_class_id"], got["BF-B"]["name"]) == ("resolved", A, "Brown")
    assert (got["TWO"]["status"], got["TWO"]["matches"], got["TWO"]["share_class_id"]) == ("ambiguous", 2, None)
    assert got["BLANK"]["status"] == "incomplete"
    assert (got["NOPE"]["status"], got["NOPE"]["matches"], got["NOPE"]["rejected"]) == ("unresolved", 0, 7)
    assert (got["UNASKED"]["status"], got["UNASKED"]["rejected"]) == ("unresolved", 0)


def test_search_hits_by_symbol_key_flag_exchange_and_type(spark):
    rows = [
        ("BRK-B", "BRKb", "usa", "nyse", "Stock - NYSE", 5, "x", 1),
        ("BRK-B", "BRK.B", "USA", "NYSE", "ETF", 5, "x", 2),
        ("BRK-B", "BRK/B", "Germany", "NYSE", "Stock", 6, "x", 3),
        ("BRK-B", "BRK/B", "USA", "OTC", "Stock", 7, "x", 4),
        ("BRK-B", "BRK/B", "USA", "NYSE", "Pre-Stock", 8, "x", 5),
        ("ETF", "ETF", None, None, None, None, None, 6),
    ]
    frame = spark.createDataFrame(
        rows, "symbol string, quote_symbol string, flag string, exchange string, quote_type string, id long, name string, at long"
    )
    out = IN.resolve_instruments(frame, frame, IN.is_searched_listing(), "id", ["name"], "at")
    got = {r["symbol"]: (r["status"], r["id"], r["rejected"]) for r in out.collect()}
    assert got == {"BRK-B": ("resolved", 5, 3), "ETF": ("unresolved", None, 1)}
    assert [r["symbol"] for r in IN.unresolved_violations(out).collect()] == ["ETF"]


def test_no_rows(spark):
    empty = spark.createDataFrame([], MAPPED)
    asked = spark.createDataFrame([("A",)], "symbol string")
    out = IN.resolve_instruments(asked, empty, IN.is_mapped_listing(), "share_class_id", ["name"], "at")
    assert [(r["symbol"], r["status"]) for r in out.collect()] == [("A", "unresolved")]
    assert IN.resolve_instruments(asked.where(F.lit(False)), empty, IN.is_mapped_listing(), "share_class_id", ["name"], "at").count() == 0
