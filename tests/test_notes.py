"""Notes on whole lists of domain names, against plain Python over random lists."""

from __future__ import annotations

import random
import re
from collections import Counter

from caseframe.plans import notes

COLUMNS = ("case_id", "pos", "domain", "status", "kind", "contacts", "account", "holder", "passport", "passport_place", "passport_date", "service_status", "verdict", "error", "error_code", "identity", "whois_error")
SCHEMA = ", ".join(f"{c} {'int' if c in ('case_id', 'pos') else 'string'}" for c in COLUMNS)


def expected(rows: list[dict]) -> list[tuple]:
    """(place, subject, counts, domains) of one case's notes."""
    rows = sorted(rows, key=lambda r: r["pos"])
    found, out = [r for r in rows if r["status"] == "found"], []
    by_count = lambda values: sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))
    states = [r["service_status"] or "—" for r in found]
    if any(not s.startswith("Активна") for s in states):
        out.append((1, None, by_count(states), []))
    if found and not any(r["verdict"] for r in found):
        out.append((2, None, [("found", len(found))], []))
    for account in {r["account"] or "—" for r in found}:
        owners: dict[tuple, list] = {}
        for r in found:
            if (r["account"] or "—") == account:
                owners.setdefault((r["kind"] or "", re.sub(r"\D", "", r["passport"] or "") or (r["holder"] or "").upper()), []).append(r["holder"] or "—")
        if len(owners) > 1:
            out.append((3, account, [(v[0], len(v)) for v in owners.values()], []))
    for passport in {re.sub(r"\D", "", r["passport"] or "") for r in found if r["kind"] == "person"} - {""}:
        own = [r for r in found if r["kind"] == "person" and re.sub(r"\D", "", r["passport"] or "") == passport]
        places, dates = (Counter((r[c] or "").strip() for r in own) for c in ("passport_place", "passport_date"))
        if len(places) > 1 or len(dates) > 1:
            rare = [r["domain"] for r in own if places[(r["passport_place"] or "").strip()] < max(places.values()) or dates[(r["passport_date"] or "").strip()] < max(dates.values())]
            out.append((4, passport, [("names", len(own))], rare))
    errors = [r for r in rows if r["whois_error"]]
    if errors:
        out.append((6, None, by_count(r["whois_error"] for r in errors), [r["domain"] for r in errors]))
    several = [r for r in rows if r["error_code"] == "ambiguous"]
    if several:
        gone = [r["domain"] for r in several if (s := re.findall(r"\d+ \((\w+|\?)\)", r["error"] or "")) and set(s) == {"D"}]
        out.append((7, None, [("ambiguous", len(several))], gone))
    asked = [r for r in found if r["identity"]]
    if asked:
        out.append((8, None, by_count(r["identity"] for r in asked), [r["domain"] for r in asked if r["identity"] == "mismatch"]))
    other = [r["contacts"] or "?" for r in found if r["kind"] not in ("person", "org")]
    if other:
        out.append((9, None, list(Counter(other).items()), []))
    return sorted(out, key=lambda n: (n[0], n[1] or ""))


def test_notes_of_random_lists(spark):
    draw = random.Random(8)
    pick = draw.choice
    rows = []
    for case in range(40):
        for pos in range(draw.randint(0, 9)):
            rows.append({
                "case_id": case, "pos": pos, "domain": f"d{pos}.ru", "status": pick(["found", "found", "not_found", "error"]), "kind": pick(["person", "person", "org", "other", None]), "contacts": pick(["x", "y", None]),
                "account": pick(["a", "b", "", None]), "holder": pick(["ТЕСТОВ", "ДРУГОЙ"]), "passport": pick(["4509 123456", "4509123456", "", None]), "passport_place": pick(["ОВД", " ОВД ", "УВД", None]), "passport_date": pick(["1", "2"]),
                "service_status": pick(["Активна", "Активна (A)", "Удалена", None]), "verdict": pick([None, None, None, "ok"]), "error": pick(["12 (D), 3 (D)", "1 (A), 2 (D)", "1 (?)", None]), "error_code": pick(["ambiguous", None, None]),
                "identity": pick(["match", "mismatch", None, None]), "whois_error": pick(["timeout", "refused", "", None, None]),
            })
    frame = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)
    got: dict[int, list] = {}
    for r in notes.list_notes(frame).collect():
        got.setdefault(r.case_id, []).append((r.place, r.subject, [(c.value, c.n) for c in r.counts], r.domains))
    want = {case: found for case in range(40) if (found := expected([r for r in rows if r["case_id"] == case]))}
    assert {k: sorted(v, key=lambda n: (n[0], n[1] or "")) for k, v in got.items()} == want


def test_no_lookups_give_no_notes(spark):
    assert notes.list_notes(spark.createDataFrame([], SCHEMA)).count() == 0
