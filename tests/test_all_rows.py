"""Queries over all rows, also those with characters beyond ASCII, against plain Python."""

import re

import pytest

import __spark_entry__ as entry
from caskwise.functions.classes import QUALIFIERS

VALUES = ["40%", "４０ %", "40.5\u00a0% vol", "\u00a045\u3000", "٤٠ %", "90\u00a0Proof 45%", "８０ proof 40%", "élevé 12%", "％ 40", "", None, "Château  Élan", "chateau\u00a0ÉLAN", "Ångström Gin", "ångström\u2003gin x"]
CLASSES = ["Crème Liqueur with Café", "Premium\u00a0Crème", "Whisky finished\u00a0in Añejo casks", "Añejo\u00a0(100%)", "Table Rosé\u00a0", "gin"]


def number(text, pattern):
    m = re.search(pattern, text or "")
    return float(m.group(1)) if m else None


def abv(text):
    first = number(text, r"(\d+\.?\d*)\s*%")
    return number((text or "").strip(), r"^(\d+\.?\d*)$") if first is None else first


def proof(text):
    return number(text, r"(\d+\.?\d*)\s*[Pp]roof")


@pytest.fixture
def folder(spark, tmp_path):
    pairs = [(a, b) for a in VALUES for b in VALUES]
    rows = [(2 * n + k, f, a, b) for n, (a, b) in enumerate(pairs) for k, f in enumerate(("alcohol_content", "brand_name"))]
    spark.createDataFrame(rows, "result_id bigint, field_name string, declared_value string, extracted_value string").write.parquet(f"{tmp_path}/comparison_results.parquet")
    spark.createDataFrame(list(enumerate(CLASSES)), "row_id bigint, class_type string").write.parquet(f"{tmp_path}/applications.parquet")
    return str(tmp_path), pairs


def test_all_rows_against_python(spark, rows, folder):
    d, pairs = folder
    run = lambda name: {r[0]: tuple(r)[1:] for r in entry.queries()[name](spark, d).collect()}
    assert run("abv_and_proof") == {2 * n: (abv(b), proof(b)) for n, (_, b) in enumerate(pairs)}
    agreed = {}
    for n, (a, b) in enumerate(pairs):
        found, declared = abv(b), abv(a)
        status = "field_missing" if not b or found is None else "match" if declared is not None and abs(found - declared) <= 0.1 else "content_mismatch"
        agreed[2 * n] = (status, proof(b) is not None and found is not None and abs(proof(b) - 2 * found) > 0.5)
    assert run("abv_agreement") == agreed
    diffs = {}
    for n, (a, b) in enumerate(pairs):
        x, y = (a or "").lower().split(), (b or "").lower().split()
        most = max(len(x), len(y))
        diffs[2 * n + 1] = (sum(x[i : i + 1] != y[i : i + 1] for i in range(most)), most)
    assert run("word_diffs") == diffs
    bases = {}
    for n, base in enumerate(CLASSES):
        text = base
        for p in QUALIFIERS:
            text = re.sub(p, "", text, flags=re.IGNORECASE).strip()
        bases[n] = (base, text)
    assert run("qualifier_strip") == bases
