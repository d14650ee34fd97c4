import html
import math
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from contrastkit.functions import numeric, text


def values(spark, rows, expression, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
    return [r[0] for r in frame.orderBy("k").select(expression).collect()]


def test_clean_text(spark):
    rows = ["<p>a&amp;b &lt;c&gt;</p>", "x<script>var a='</p>';</script>y<STYLE type='t'>p{}</style>z", "a&nbsp; b\x85c\x1cd", None, "", "&eacute;<br/>&#8364;"]
    assert values(spark, rows, text.clean_text(F.col("v"))) == ["a&b <c>", "x y z", "a b c d", "", "", "é €"]


def test_page_parts(spark):
    page = '<tr><th> Drug Name </th><td class="x"> A &amp; B </td></tr><tr><th>Payload</th><td><a href="/data/payload/PAY1">P</a></td></tr> One Two body Three <div class="u"> rest'
    rows = [page, "no such cells", page.replace(" Three", ""), "Two One"]
    v = F.col("v")
    assert values(spark, rows, text.labelled_value(v, "Drug Name")) == ["A & B", "", "A & B", ""]
    assert values(spark, rows, text.labelled_link_id(v, "Payload", "/data/payload")) == ["PAY1", "", "PAY1", ""]
    assert values(spark, rows, text.section(v, "One", "Two", "Three", '<div class="u">')) == ["Two body ", "", "Two body ", ""]
    assert values(spark, [page.replace("Three", "").replace('<div class="u">', "")], text.section(v, "One", "Two", "Three", '<div class="u">'))[0].endswith("rest")


def test_records(spark):
    row = '<td class="pad-20">IC50 {a}</td><td class="h-center"><div> {v} </div></td><td class="h-center"><div>nM</div></td><td class="pad-20"><div>cell</div></td><td class="pad-20"><div>disease</div></td>'
    block = row.format(a='<a href="#ACT1">1</a>', v="&lt; 3.4") + "\n" + row.format(a="", v="12")
    frame = spark.createDataFrame([(block,)], "v string").select(F.explode(text.records(F.col("v"))).alias("m"))
    got = frame.select(*[text.record_field(F.col("m"), k).alias(n) for k, n in enumerate(text.RECORD_FIELDS, 1)]).collect()
    assert [r["activity_id"] for r in got] == ["ACT1", ""] and [r["value_raw"] for r in got] == ["&lt; 3.4", "12"]
    assert [r["disease_model"] for r in got] == ["disease", "disease"]


def test_relations_and_numbers(spark):
    rows = [">= 5", "<=5", ">5", "< 5 nM", "=5", " 5 ", ""]
    assert values(spark, rows, text.relation_of(F.col("v"))) == [">=", "<=", ">", "<", "=", "=", "="]
    assert values(spark, rows, text.value_of(F.col("v"))) == ["5", "5", "5", "5 nM", "5", "5", ""]
    rows = [".5", "1,000", "3.4 ± 1", "-2e3x", "none", "1e999", ""]
    assert values(spark, rows, text.first_number(F.col("v"))) == [5.0, 1.0, 3.4, -2000.0, None, None, None]
    assert values(spark, ["1.5", "NaN", "inf", "x", " 2 ", ""], text.strict_number(F.col("v"))) == [1.5, None, None, None, 2.0, None]


def test_predicates_and_identity(spark):
    assert values(spark, ["IC 50", "lc50 (x)", "Cmax", None], text.contains_any(F.col("v"))) == [True, True, False, False]
    assert values(spark, ["nM", " PM ", "µM", "μM", "umol/L", "mg"], text.is_molar(F.col("v"))) == [True, True, True, True, False, False]
    assert values(spark, ["", "x", None], text.first_filled(F.col("v"))) == ["<missing payload>", "x", "<missing payload>"]


def test_class_rules(spark):
    cases = {
        "Topo-isomerase I": "Topo-I inhibitor",
        "topoisomerase 1 inhibitor": "Topo-I inhibitor",
        "Tubulin": "microtubule-disrupting",
        "DNA": "DNA-damaging",
        "DNA topoisomerase I": "Topo-I inhibitor",
        "topoisomerase ii": "Other",
        "TOP2A dna": "DNA-damaging",
        "DNA and tubulin": "Other",
        "": "Other",
        "unknown": "Other",
        "SN-38 (TOP1)": "Topo-I inhibitor",
    }
    assert dict(zip(cases, values(spark, list(cases), text.class_by_rules(F.col("v"))))) == cases


def test_lists_and_letters(spark):
    assert values(spark, ["a;b;;c", ""], text.split_values(F.col("v"))) == [["a", "b", "c"], []]
    assert values(spark, ["A", "Z", "AA", "ab12", "XFD"], text.letters_index(F.col("v"))) == [0, 25, 26, 27, 16383]
    got = spark.createDataFrame([("b",), ("a",), ("",), (None,), ("b",)], "v string").agg(text.joined_values(F.col("v"))).first()[0]
    assert got == "a;b"


def test_units(spark):
    units = {"pM": 0.01, "nM": 10.0, "uM": 10000.0, "µM": 10000.0, "μM": 10000.0, "umol/L": 10000.0, "mg/mL": None, "": None}
    assert dict(zip(units, values(spark, list(units), numeric.in_nm(F.lit(10.0), F.col("v"))))) == units
    assert values(spark, ["x", "5"], numeric.in_nm(F.col("v"), F.lit("nM"))) == [None, 5.0]


@pytest.mark.parametrize("relation,low,at,high", [("=", 1, 1, 0), ("<", 1, 1, None), ("<=", 1, 1, None), (">", None, 0, 0), (">=", None, None, 0), ("~", None, None, None)])
def test_threshold(spark, relation, low, at, high):
    got = values(spark, [9.0, 10.0, 11.0, math.nan, math.inf], numeric.threshold_label(F.lit(relation), F.col("v")), "double")
    assert got == [low, at, high, None, None]


def test_small_numbers(spark):
    assert values(spark, [1e-13, -1e-13, 0.5, -0.5, None], numeric.sign(F.col("v")), "double") == [0, 0, 1, -1, 0]
    frame = spark.createDataFrame([(float(k),) for k in range(50)], "v double")
    assert frame.agg(numeric.floor_percentile(F.col("v")), numeric.linear_percentile(F.col("v"), 0.5)).first() == (46.0, 24.5)
    assert values(spark, ["7", "x", None], numeric.int_or(F.col("v"), 9)) == [7, 9, 9]
    assert values(spark, [0.0, 2.0], numeric.ratio(F.lit(1), F.col("v")), "double") == [None, 0.5]
    frame = spark.createDataFrame([("z",), ("b",), ("a",), ("q",)], "v string")
    assert [r[0] for r in frame.orderBy(numeric.enum_order(F.col("v"), ["b", "z"])).collect()] == ["b", "z", "a", "q"]


def test_entities_are_those_of_the_standard_library(spark):
    names = [f"a&{n}b" for n in html5] + [f"&{n.rstrip(';')} x" for n in html5] + [f"&{n[:-1]}" for n in html5 if len(n) > 2]
    names += ["", "&", "&&amp;&", "& amp;", "&#;", "&#x;", "&#xg;", "&#38", "&#0038;x", "&#x26;#38;", "&#99999999999999999999;", "&#x00000000041;", "&notit;&notin;&ampersand;&amplt;", "&" + "a" * 40 + ";", "&a\tb;", "&é;", "&#12\n", "a&b", "x&lt", "&#1114112;"]
    got = spark.createDataFrame([(x,) for x in names] + [(None,)], "x string").select("x", text.unescaped(F.col("x")).alias("y")).collect()
    assert len(got) == len(names) + 1
    for r in got:
        assert r["y"] == (html.unescape(r["x"]) if r["x"] is not None else None), r["x"]


def test_number_references_of_all_code_points(spark):
    each = spark.range(0, 0x110100, numPartitions=8).select("id", text.unescaped(F.format_string("&#%d;|&#x%x", "id", "id")).alias("y"))
    wrong = [r["id"] for r in each.toLocalIterator() if r["y"] != html.unescape(f"&#{r['id']};|&#x{r['id']:x}")]
    assert wrong == []


def test_record_table_takes_all_groups(spark):
    block = "noise <i>1</i><b>x\ufdd0y</b> and <I>2</I> more <i>3</i><b></b> end"
    pattern = "(?is)<i>(.*?)</i>(?:<b>(.*?)</b>)?"
    rows = spark.createDataFrame([(block,), ("",), (None,)], "x string").select(text.record_table(F.col("x"), pattern, ["n", "b"]).alias("r")).collect()
    assert [[(m["n"], m["b"]) for m in r["r"] or []] for r in rows] == [[("1", "x\ufffdy"), ("2", ""), ("3", "")], [], []]
