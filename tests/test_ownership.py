"""Ownership forms: the XML and the HTML of one filing give equal rows."""

from datetime import date

from tallyworks.operators.ownership import COLUMNS, ownership_transactions


def xml(deals, name="Jane Doe", space=""):
    tx = "".join(
        f"<nonDerivativeTransaction><transactionDate><value>{d}</value></transactionDate><transactionCoding><transactionCode>{c}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{n}</value></transactionShares>"
        f"<transactionPricePerShare>{f'<value>{p}</value>' if p else '<footnoteId id=\"F1\"/>'}</transactionPricePerShare></transactionAmounts><ownershipNature><directOrIndirectOwnership><value>{o}</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>"
        for d, c, n, p, o in deals
    )
    whole = f"<?xml version='1.0'?><ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>{name}</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isTenPercentOwner>true</isTenPercentOwner></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{tx}</nonDerivativeTable></ownershipDocument>"
    return whole if not space else whole.replace("</", f"</{space}:").replace("<own", f"<{space}:own").replace("<non", f"<{space}:non").replace("<rep", f"<{space}:rep").replace("<rpt", f"<{space}:rpt").replace("<is", f"<{space}:is").replace("<trans", f"<{space}:trans").replace("<value", f"<{space}:value").replace("<direct", f"<{space}:direct")


def html(deals, name="Jane Doe"):
    rows = "".join(
        f"<tr><td>Common Stock</td><td>{d[5:7]}/{d[8:]}/{d[:4]}</td><td></td><td><b>{c}</b></td><td></td><td>{int(n):,}<sup>(2)</sup></td><td>D</td><td>{f'<span>$</span><span>{p}</span>' if p else ''}<sup>(1)</sup></td><td>9,999</td><td>{o}</td><td></td></tr>" for d, c, n, p, o in deals
    )
    top = f'<table><tr><td>1. Name<table><tr><td><a href="/cgi?action=getcompany&amp;CIK=1">{name}</a></td></tr></table></td><td>5. Relationship<table><tr><td>X</td><td>Director</td><td>X</td><td>10% Owner</td></tr><tr><td></td><td>Officer (give title below)</td><td></td><td>Other</td></tr></table></td></tr></table>'
    head = "<tr><th colspan=11>Table I - Non-Derivative Securities Acquired, Disposed of</th></tr><tr><th>1. Title</th><th>2. Transaction Date</th><th>2A.</th><th colspan=2>3. Transaction Code</th><th colspan=3>4. Securities</th><th>5. Owned</th><th>6. Form</th><th>7.</th></tr><tr><th></th><th></th><th></th><th>Code</th><th>V</th><th>Amount</th><th>(A) or (D)</th><th>Price</th><th></th><th></th><th></th></tr>"
    return f"<html>{top}<table>{head}{rows}</table></html>"


DEALS = [("2026-06-10", "P", "1000", "12.50", "D"), ("2026-06-11", "S", "50000", "311.02", "I"), ("2026-06-12", "A", "7", None, "D"), ("2026-06-12", "Z", "1", "1", "D")]


def test_xml_and_html_agree(spark):
    bodies = [xml(DEALS), html(DEALS), xml(DEALS, space="ns1"), "<ownershipDocument><broken", "<html></html>", None, xml([])]
    rows = ownership_transactions(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")).collect()
    of = lambda i: sorted(tuple(r[c] for c in COLUMNS[1:]) for r in rows if r["doc_id"] == i)
    assert of(0) == of(1) == of(2) == [
        (0, "Jane Doe", "director, ten_percent_owner", "P", "Purchase", 1000.0, 12.5, 12500.0, "D", date(2026, 6, 10)),
        (1, "Jane Doe", "director, ten_percent_owner", "S", "Sale", 50000.0, 311.02, 15551000.0, "I", date(2026, 6, 11)),
        (2, "Jane Doe", "director, ten_percent_owner", "A", "Award", 7.0, None, None, "D", date(2026, 6, 12)),
        (3, "Jane Doe", "director, ten_percent_owner", "Z", "Other/Unclassified", 1.0, 1.0, 1.0, "D", date(2026, 6, 12)),
    ]
    assert {r["doc_id"] for r in rows} == {0, 1, 2}
