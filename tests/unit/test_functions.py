import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import units as U


def value(spark, column, **data):
    frame = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in data.items()) or "x int")
    return frame.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "phrase, low, high, unit",
    [
        ("Up to 20,000 Nm3/hr", None, 20000.0, "Nm3/hr"),
        ("10000–100000 SCMD", 10000.0, 100000.0, "SCMD"),
        ("100000 to 10000 SCMD", 10000.0, 100000.0, "SCMD"),
        ("35-65 Kg/hr", 35.0, 65.0, None),
        ("500 Nm³/hr", 500.0, 500.0, "Nm3/hr"),
        ("12 and 30 nm3/h", 12.0, 12.0, "Nm3/hr"),
        ("none", None, None, None),
        ("", None, None, None),
    ],
)
def test_capacity_phrases(spark, phrase, low, high, unit):
    r = value(spark, U.parse_capacity(F.col("p")), p=phrase)
    assert (r["min"], r["max"], r["unit"]) == (low, high, unit)


def test_pressure_phrase(spark):
    r = value(spark, U.parse_pressure(F.col("p")), p="Discharge up to 1000 Barg")
    assert (r["min"], r["max"], r["unit"]) == (None, 1000.0, "barg")


@pytest.mark.parametrize("unit, canon", [("NM³ / HR", "Nm3/hr"), ("l/min", "lpm"), ("Watts", "W"), ("furlong", None), (None, None)])
def test_units(spark, unit, canon):
    assert value(spark, U.capacity_unit(F.col("u")), u=unit) == canon


@pytest.mark.parametrize("unit, canon", [("bar", "barg"), ("kg/cm²", "kg/cm2g"), ("PSIG", "psi"), ("mmHg", None)])
def test_pressure_units(spark, unit, canon):
    assert value(spark, U.pressure_unit(F.col("u")), u=unit) == canon


@pytest.mark.parametrize(
    "number, shown",
    [("25000.0", "25,000"), ("1234567", "12,34,567"), ("9999", "9999"), ("12.50", "12.5"), ("-123456.25", "-1,23,456.25"), ("0", "0"), ("n/a", "n/a")],
)
def test_number_format(spark, number, shown):
    assert value(spark, U.format_number(F.col("n")), n=number) == shown


def test_spec_numbers_and_redaction(spark):
    text = "Up to 25,000 Nm3/hr [2] at 350 barg; २० kW; 7 sites; 99 psi"
    assert sorted(value(spark, U.spec_numbers(F.col("t")), t=text)) == [20.0, 99.0, 350.0, 25000.0]
    allowed = F.array(F.lit(350.0), F.lit(25000.0))
    assert value(spark, U.redact(F.col("t"), allowed), t=text) == "Up to 25,000 Nm3/hr   at 350 barg; …; 7 sites; …"
    assert value(spark, U.redact(F.col("t"), allowed), t="") == ""


@pytest.mark.parametrize("v, limit, room, edge", [(3000.0, 20000.0, 0.85, False), (95.0, 100.0, 0.05, True), (90.0, 100.0, 0.1, False), (1.0, 0.0, None, False)])
def test_headroom(spark, v, limit, room, edge):
    got = value(spark, U.headroom(F.col("v"), F.col("l")), v=v, l=limit)
    assert got is room if room is None else abs(got - room) < 1e-9
    assert value(spark, U.near_edge(F.col("v"), F.col("l")), v=v, l=limit) is edge


def test_text_forms(spark):
    assert value(spark, T.squeeze(F.col("t")), t="  a  b\n c ") == "a b c"
    assert value(spark, T.alias_form(F.col("t")), t="KDX - 16") == "kdx16"
    assert value(spark, T.name_tokens(F.col("t")), t="Smart KDX-13/16 (Boosters) C") == ["smart", "kdx", "13", "16", "booster"]
    assert value(spark, T.tidy_markdown(F.col("t")), t="<!-- image -->\n<!-- image -->\nx\n|\nlong") == "<!-- image -->\n\n|\nlong"
    assert value(spark, T.clean_unicode(F.col("t")), t="é m³​﻿") == "é m³"
    assert value(spark, T.locator_heading(F.col("t")), t="p3 §A §B ") == "B"
    assert value(spark, T.normal_digits(F.col("t")), t="२५,०००.0 bar") == "25000 bar"
    assert value(spark, T.says(F.col("t"), F.lit("25000")), t="It is 25,000.0") is True
    assert value(spark, T.latin_leaks(F.col("t")), t="यह **KDX** published है API-618 500 Nm³/hr {x} [tr1]") == ["published"]
    assert value(spark, T.doc_id(F.col("t")), t="https://x.org/a/Gas%20Line-2.html?q=1#f") == "doc.gas_line_2"
    assert value(spark, T.doc_id(F.col("t")), t="https://x.org/") == "doc.index"
    assert value(spark, T.url_kind(F.col("t")), t="https://x.org/A.PDF?x=1") == "pdf"


def test_locators(spark):
    r = value(spark, T.parse_locator(F.col("t")), t="p12-14 §Scope › Gas")
    assert (r.page_start, r.page_end, r.heading) == (12, 14, "Scope › Gas")
    made = T.section_locator(F.array(F.col("a"), F.col("b")), F.lit(3), F.lit(4))
    assert value(spark, made, a="A", b="B") == "p3-4 §A › B"


def test_display_name(spark):
    names = dict(m=None, f="Line", v="", d=" First\nrest")
    assert value(spark, T.display_name(*map(F.col, "mfvd")), **names) == "Line — First"
    assert value(spark, T.display_name(*map(F.col, "mfvd")), **(names | {"m": "M1"})) == "M1"
    assert value(spark, T.display_name(*map(F.col, "mfvd")), **(names | {"d": None, "f": ""})) == "product"
