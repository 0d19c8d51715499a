"""What a numeric question should come to, in exact decimals over plain rows; shares no code with the engine."""

from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

CENT = Decimal("0.01")
ASKED_IN_ORDER = ("area_type", "property_type", "vat_basis")


def half_up(x, to=CENT):
    return x.quantize(to, ROUND_HALF_UP)


def current(rows, versions, documents):
    """Rows of current versions of documents that aren't deleted."""
    live = {d["document_id"] for d in documents if d["deleted_at"] is None}
    now = {v["version_id"] for v in versions if v["is_current"]}
    return [r for r in rows if r["document_id"] in live and r["version_id"] in now]


def matches(row, wanted):
    """wanted: field -> value; year is (date field, first, last)."""
    for name, value in wanted.items():
        if name == "year":
            field, first, last = value
            if row[field] is None or not first <= row[field].year <= last:
                return False
        elif row[name] != value:
            return False
    return True


def median(values):
    values = sorted(values)
    n = len(values)
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


def expected(rows, wanted, facts, statuses=("human_verified", "corrected"), awaiting=("auto_extracted", "needs_review")):
    """(outcome, detail): a clarification with its options, an abstention, or the numbers; rows are current already."""
    mine = [r for r in rows if matches(r, wanted)]
    sure = [r for r in mine if r["verification_status"] in statuses]
    for name in ASKED_IN_ORDER:
        if name not in wanted:
            per = defaultdict(set)
            for r in sure:
                if r[name] is not None:
                    per[r[name]].add(r["transaction_id"])
            if len(per) > 1:
                return "clarification", (name, {k: len(v) for k, v in per.items()})
    ids = {r["transaction_id"] for r in sure}
    waiting = len({r["transaction_id"] for r in mine if r["verification_status"] in awaiting} - ids)
    if not ids:
        return "abstain", waiting
    used = [facts[i] for i in ids if facts[i]["price"] is not None and (facts[i]["area"] or 0) > 0]
    each = [half_up(f["price"] / f["area"]) for f in used]
    numbers = {
        "n": len(each),
        "mean": half_up(sum(each) / len(each)),
        "weighted": half_up(sum(f["price"] for f in used) / sum(f["area"] for f in used)),
        "median": half_up(median(each)) if len(each) > 2 else None,
        "least": min(each),
        "most": max(each),
        "awaiting": waiting,
    }
    return "numeric", numbers


def largest(rows, keys):
    """The most frequent combination of keys, the least of equals."""
    return min(Counter(tuple(r[k] for k in keys) for r in rows).items(), key=lambda x: (-x[1], x[0]))
