"""Whole licences and copyright lines without a year."""

import pytest
from tessella.llm import licenses
from tessella.llm.license_texts import BODIES, known_texts


def test_whole_licenses(spark):
    texts = known_texts()
    rows = [(i, texts[name].replace("\n", "\r\n").upper()) for i, name in enumerate(BODIES)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(BODIES))


def test_terms_without_advice_and_with_other_addresses(spark):
    texts = known_texts()
    gpl = texts["GPL-2.0"]
    rows = [(1, texts["Apache-2.0"].split("APPENDIX:")[0]), (2, gpl.split("How to Apply")[0].replace("51 Franklin Street, Fifth Floor,", "59 Temple Place, Suite 330,").replace("02110-1301", "02111-1307")), (3, gpl + " more")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Apache-2.0 (terms, end marked)", 2: "GPL-2.0 (terms, end marked) (59 Temple Place)", 3: None}


@pytest.mark.parametrize("line", ["Copyright (c) Acme Ltd.", "Copyright (c) <COPYRIGHT HOLDERS>", "Copyright [yyyy] [name of owner]", " * © Acme Ltd.", "Copyright © Acme Ltd."])
def test_copyright_lines_without_a_year(spark, line):
    rows = [(1, "MIT License\n\n" + line + "\n\n" + licenses.TEXTS["MIT (untitled)"])]
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).first()["license"] == "MIT"


def test_wrapped_body_lines_stay(spark):
    rows = [(1, "one\ncopyright notice and disclaimer"), (2, "one\n(c) You must retain"), (3, "one")]
    assert len({r["text_sha256"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}) == 3
