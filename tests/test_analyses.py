import random

from contrastkit.functions.text import MAJOR
from contrastkit.plans import analyses
from contrastkit.sources import report


def table(spark):
    draw = random.Random(6)
    rows = []
    for k in range(500):
        cls = draw.choice([*MAJOR, "Other"])
        rows.append((k, f"d{k % 60}", cls, f"{cls}-{draw.randrange(6)}", f"cell{draw.randrange(6)}", f"anti{draw.randrange(4)}", draw.choice(["=", "=", "=", "<", ">"]), draw.choice(["1", "5", "30", "", "400"]), draw.choice(["nM", "nM", "uM", "mg"]), draw.choice(["IC50", "EC 50", "Cmax"]), "0"))
    return spark.createDataFrame(rows, "row_id int, adc_id string, payload_mechanism string, payload_identity string, cell_line string, antigen_name string, relation string, value_numeric string, units string, standard_type string, is_potency_endpoint string").cache()


def test_audit(spark):
    out = analyses.activity_audit(table(spark))
    assert out["verdict"].first()["decision"] == "NOT_TESTABLE"  # six keys only
    assert out["classes"].count() == 4 and out["dependency"].first()["single_share"] == 1.0
    assert "| payload_mechanism |" in report.markdown(out["classes"])
    text = report.analysis_report("Audit", out, report.AUDIT)
    assert text.count("\n## ") == len(report.AUDIT) and "| NOT_TESTABLE |" in text


def test_study_accounts_for_every_row(spark):
    rows = table(spark)
    out = analyses.study(rows, repeats=2, k=3, always=True)
    kept = sum(r["source_rows"] for r in out["collapsed"].collect())
    assert kept + sum(r["rows"] for r in out["exclusions"].collect()) == rows.count()
    assert out["gate"].first()["decision"] in ("GO_FOR_CHEAP_FALSIFICATION", "PIVOT", "KILL")
    pooled = out["pooled"].collect()
    assert len({(r["split"], r["model"]) for r in pooled}) == len(pooled) == 5 * 9
    assert out["shuffled"].count() == 2 and out["verdict"].first()["decision"] in ("GO", "PIVOT")


def test_contrasts(spark):
    rows = analyses.study(table(spark))["collapsed"].where("payload_mechanism <> 'Other'")
    out = analyses.contrasts(rows, ["cell_line", "antigen_name"], "payload_mechanism", "payload_identity", "label", {"permutation": 50, "bootstrap": 20}, order=MAJOR)
    text = report.analysis_report("Contrasts", out, report.CONTRASTS, limit=3)
    assert text.count("\n## ") == len(report.CONTRASTS) and "PIVOT" in text + "PIVOT" * ("KILL" in text)
    assert out["summary"].count() == 3 and out["verdict"].count() == 1
    assert {tuple(r) for r in out["summary"].select("class_a", "class_b").collect()} == {(MAJOR[0], MAJOR[1]), (MAJOR[0], MAJOR[2]), (MAJOR[1], MAJOR[2])}
    assert 0 < out["survival"].first()["units_share"] <= 1
    assert all(0 < r["p"] <= 1 for r in out["pair_permutation"].collect())
