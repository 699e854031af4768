"""Shapes, citations, templates, titles and dates."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import headings, metadata


@pytest.fixture(scope="module")
def derived(spark):
    kind = "k int, native_id string, headings array<string>, levels array<int>, category string, body string, published string, refs array<string>, phrase string"

    def run(*documents):
        rows = [(i, d["id"], d.get("heads"), d.get("levels", list(range(1, len(d.get("heads") or []) + 1))), d.get("folder"), d.get("body"), d.get("published"), d.get("refs"), d.get("phrase")) for i, d in enumerate(documents)]
        return [(r.template, r.title, r.date) for r in metadata.derive(spark.createDataFrame(rows, kind), "k").orderBy("k").collect()]

    return run


def test_shapes(spark):
    told = {
        "Taxation Ruling": "ruling_kind", "TR 2024/3": "ruling", "[2024] HCA 41": "neutral", " ": "empty", "ATO ID 2003/12": "decision", "PS LA 1998/1": "practice", "SMSFRB 2018/1": "bulletin", "IT 2650": "numbered",
        "TR 95/D3": "ruling", "MT 2024/1": "ruling", "Decision Impact Statement": "impact_kind", "Income Tax Assessment Act 1997": "act", "Income Tax Assessment Act 1997 (Cth)": "act", "Tax Bill 2005": "bill",
        "Re Smith": "matter", "Ex parte Jones": "matter", "Case 12/97": "case_number", "Smith v Jones": "versus", "Smith & Co Pty Ltd v. The Commissioner": "versus", "A" * 300 + " v B": "subject", "Regarding the rest": "subject", "Acting in 1997": "subject",
    }
    rows = spark.createDataFrame(list(enumerate(told)), "k int, t string").select("k", headings.shape(headings.plain(F.col("t"))).alias("s")).orderBy("k").collect()
    assert [r.s for r in rows] == list(told.values())
    assert set(told.values()) <= set(headings.SHAPES)


def test_citations(spark):
    told = {"LCR 2019/2EC (Withdrawn)": ("LCR 2019/2EC", 2019), "TR 95/D3": ("TR 95/D3", 1995), "  PS LA  1998/1 ( withdrawn )": ("PS LA 1998/1", 1998), "[1999] HCA 12 at 5": ("[1999] HCA 12", 1999), "nothing": ("nothing", None), "": ("", None)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "k int, t string").withColumn("c", headings.clean_citation(F.col("t")))
    assert [(r.c, r.y) for r in df.select("k", "c", headings.cited_year(F.col("c")).alias("y")).orderBy("k").collect()] == list(told.values())


def test_publications(derived):
    assert derived(
        {"id": "TXR/TR20243/NAT/ATO/00001", "heads": ["Taxation Ruling", "TR 2024/3", "R&D tax incentive eligibility"]},
        {"id": "TXR/TR20243", "heads": ["TR 2024/3 (Withdrawn)", "TR 2024/3", "Losses"], "body": "issued on 12 March 2024 by us"},
        {"id": "AID/X", "heads": ["ATO Interpretative Decision", "ATO ID 2003/12"]},
        {"id": "ITR/IT2650", "heads": ["IT 2650 — Residency", "Subject"]},
        {"id": "SRB/1", "heads": ["SMSF Regulator's Bulletin", "SMSFRB 2018/1", "Reserves"]},
    ) == [
        ("publication", "TR 2024/3 — R&D tax incentive eligibility", "2024-01-01"),
        ("publication", "TR 2024/3 (Withdrawn) — Losses", "2024-03-12"),
        ("publication", "ATO ID 2003/12", "2003-01-01"),
        ("publication", "IT 2650 — Subject", None),
        ("bulletin", "SMSFRB 2018/1 — Reserves", "2018-01-01"),
    ]


def test_cases(derived):
    mail = "[x](mailto:?subject=a&body=Cases%0D%0ASmith%20v%20Jones%20-%20%2827%20ALJ%201%29%0D%0Alink:%20x) rest"
    assert derived(
        {"id": "JUD/1999", "heads": ["[1999] HCA 12", "Smith v Jones"]},
        {"id": "JUD/X", "heads": ["Smith v. Jones [2001] HCA 3"], "body": "(1987) 12 ATR text"},
        {"id": "JUD/*1954*27ALJ", "heads": ["A heading"], "body": mail},
        {"id": "JUD/*1954*27ALJ", "heads": []},
        {"id": "JUD/Z", "heads": ["Front", "Smith v Jones"], "folder": "Cases", "body": "[2003] FCA 8"},
        {"id": "JUD/Z", "heads": ["Front matter", "Second"], "folder": "Cases"},
        {"id": "DIS/DIS2024_PEPSICO/NAT/ATO", "heads": ["Decision impact statement", "Pepsico Inc v Commissioner of Taxation"]},
        {"id": "JUD/Q", "heads": ["Case 12/97", "Notes"]},
        {"id": "JUD/Q", "heads": ["The court — Smith v Jones", "Notes"], "folder": "Cases"},
    ) == [
        ("case", "[1999] HCA 12", "1999-01-01"),
        ("case", "Smith v Jones", "1987-01-01"),
        ("old_case", "Smith v Jones", "1954-01-01"),
        ("old_case", "*1954*27ALJ", "1954-01-01"),
        ("case_below", "Smith v Jones", "2003-01-01"),
        ("case", "Front matter", None),
        ("impact", "DIS: Pepsico Inc v Commissioner of Taxation", None),
        ("case", "Case 12/97", None),
        ("case", "The court — Smith v Jones", None),
    ]


def test_laws(derived):
    assert derived(
        {"id": "PAC/19970038/995-1", "heads": ["Income Tax Assessment Act 1997"]},
        {"id": "PAC/19970038/995-1", "heads": ["Part one"]},
        {"id": "REG/19990012/4", "heads": ["Part one"], "published": "2000-05-06"},
        {"id": "ACT/INCOME_TAX_ASSESSMENT_1997", "heads": ["Income Tax Assessment Act 1997"], "body": "1 May 1998"},
        {"id": "NEM/1", "heads": ["Tax Laws Amendment Bill 2005", "Notes"]},
        {"id": "NEM/1", "heads": ["Explanatory Memorandum", "Chapter 1"], "body": "about the **Fuel Tax Bill 2006** of 3 June 2006"},
        {"id": "NEM/1", "heads": ["Explanatory Memorandum", "Chapter 1"], "refs": ["Tax Bill 2001"], "phrase": "Explanatory Memorandum"},
    ) == [
        ("section", "Income Tax Assessment Act 1997 s 995-1", "1997-01-01"),
        ("section", "Act 1997 No. 38 s 995-1", "1997-01-01"),
        ("section", "Regulations 1999 reg 4", "1999-01-01"),
        ("act", "Income Tax Assessment Act 1997", "1997-01-01"),
        ("bill", "EM to Tax Laws Amendment Bill 2005", "2005-01-01"),
        ("bill", "EM to Fuel Tax Bill 2006", "2006-06-03"),
        ("bill", "Explanatory Memorandum — Tax Bill 2001", None),
    ]


def test_what_is_left(derived):
    assert derived(
        {"id": "EV/1012101718232/00001", "folder": "Edited_private_advice"},
        {"id": "EV/1", "folder": "Edited_private_advice", "body": "Date of advice: 7 May 2015."},
        {"id": "XYZ/abc/def"},
        {"id": "AID/AID20035", "heads": ["Subject"], "levels": [1]},
        {"id": "TXR/TR20015"},
        {"id": "TXR/TR955"},
        {"id": "PSR/PSD20041"},
        {"id": ""},
        {"id": None, "heads": None},
        {"id": "X/Y", "heads": ["One", "one more", "Two", "Three"], "levels": [1, 2, 2, 3]},
        {"id": "X/Y", "heads": ["Second"], "levels": [2]},
        {"id": "X/Y", "heads": ["a"], "levels": [1, 2], "refs": [" ", "Ref 1"], "published": "2020-02-03"},
    ) == [
        ("advice", "EV 1012101718232", None),
        ("advice", "EV 1", "2015-05-07"),
        ("other", "XYZ abc", None),
        ("other", "Subject", "2003-01-01"),
        ("other", "TR 2001/5", "2001-01-01"),
        ("other", "TR 95/5", "1995-01-01"),
        ("other", "PS LA 2004/D1", "2004-01-01"),
        ("other", None, None),
        ("other", None, None),
        ("other", "One — Three", None),
        ("other", "Second", None),
        ("other", "Ref 1", "2020-02-03"),
    ]
