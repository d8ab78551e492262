import hashlib
import re

import numpy as np

from mvspark.llm import pii
from tests.llm.helpers import awkward, frame

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out, counts = [], []
    for kind, rule in RULES.items():
        n = 0
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            n += 1
            out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest()), set(out)


TEXTS = [
    "mail a.b@c-d.example.com, x@y.z_w@q.r and a@b.c.d@e.f or @no.where",
    "é😀 1.2.3.4.5.6.7.8 and 256.1.1.1 or 0001.02.003.255 at 1.2.3",
    "card 4539 1488 0343 6467, 4539-1488-0343-6467 4539148803436468 12345678901234567890",
    "call +1 (555) 010-9999, +49.30.1234567 or +12 345 or + 123456789",
    "+1 (269) 555-3296 4539148803436467 glued",
    "a" * 30_000 + "@" + "b" * 30_000 + ".com " + "9" * 20_000 + " " + "1.1." * 5_000,
    "x" * 40_000,
    "",
]


def test_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    bits = ["a@b.co", "+1 555 010 9999", "10.0.0.1", "4539148803436467", " ", "-", ".", "@", "+", "word", "é", "7", "@x.y", "(3)", "_"]
    texts = TEXTS + ["".join(rng.choice(bits, 12)) for _ in range(300)]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(frame(spark, list(enumerate(texts))))).collect()}
    for k, text in enumerate(texts):
        want, spans = plain(text)
        r = got[k]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want, text[:80]
        assert spans <= set(r["spans"].split(",")) | {""}


def test_trees_add_glued_numbers_and_leave_clean_text_alone(spark):
    rng = np.random.default_rng(4)

    def card():
        d = [4, *rng.integers(0, 10, 14).tolist()]
        d.append(next(c for c in range(10) if luhn("".join(map(str, [*d, c])))))
        return "".join(map(str, d))

    phone = lambda: "+1 (%03d) 555-%04d" % (rng.integers(200, 999), rng.integers(10000))
    lead = lambda: rng.choice(["call ", "ours is ", "see ", ""])
    texts = [f"{lead()}{phone()} today" for _ in range(150)] + [f"{lead()}{card()} now" for _ in range(150)]
    texts += [f"in {rng.integers(1900, 2030)} we had {rng.integers(10, 99)} of {rng.integers(1000, 9999)} parts" for _ in range(150)]
    glued = len(texts)
    texts.append(f"{phone()} {card()} end")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(frame(spark, list(enumerate(texts))))).collect()}
    assert got[glued] == "card:18:34,phone:0:17"
    assert not any(got[k] for k in range(300, 450))


WIDE_ONLY = [
    ("call 555-010-9999 now", "phone", "555-010-9999"), ("phone: 030 1234567", "phone", "030 1234567"), ("write to jane.roe (at) example (dot) net please", "email", "jane.roe (at) example (dot) net"),
    ("contact p.young [at] mail [dot] example [dot] org", "email", "p.young [at] mail [dot] example [dot] org"), ("mail: lena at beispiel dot de", "email", "lena at beispiel dot de"),
    ("my card 3782 822463 10005 expires", "card", "3782 822463 10005"), ("tel. (212) 555-0147", "phone", "(212) 555-0147"), ("Fax 0221 4710 815 or so", "phone", "0221 4710 815"),
    ("text me on 917.555.0123", "phone", "917.555.0123"), ("ring 1-800-555-0199 after", "phone", "1-800-555-0199"),
]
CLEAN = ["order 555-010-9999 shipped", "isbn 978-3-16-148410-0", "on 2024-01-15 and 15.01.2024 it was", "a total of 1 234 567 people", "serial 030 1234567", "version 10.20304050", "look at this dot here", "we met at ten dot sharp", "part 3782 822463 10006", "pi is 3.14159265358979", "between 1990 2000 2010 2020", "ticket 00123456789 was closed"]


def test_trees_find_what_the_base_rules_miss(spark):
    texts = [t for t, _, _ in WIDE_ONLY] + CLEAN
    got = {r["doc_id"]: r for r in pii.digest(pii.find(frame(spark, list(enumerate(texts))))).collect()}
    found = 0
    for k, (text, kind, span) in enumerate(WIDE_ONLY):
        assert got[k]["n_email"] + got[k]["n_ip"] + got[k]["n_card"] + got[k]["n_phone"] == 0
        at = text.index(span)
        found += got[k]["spans"] == f"{kind}:{at}:{at + len(span)}"
    assert found >= 0.9 * len(WIDE_ONLY), [got[k]["spans"] for k in range(len(WIDE_ONLY))]
    assert [got[len(WIDE_ONLY) + k]["spans"] for k in range(len(CLEAN))] == [""] * len(CLEAN)


def test_seeds_are_labelled_both_ways_and_held_out_precision_is_kept(spark):
    rows = pii.seeds()
    assert 0.3 < sum(r[4] for r in rows) / len(rows) < 0.7 and len({r[1] for r in rows}) > 500
    _, trees, levels = pii.trained(spark)
    assert trees and all(np.isfinite(levels[k]) for k in (0, 2, 3))


def test_redaction_by_row_and_with_overlaps(spark):
    rows = [(None, "nothing here"), (None, "mail me@home.org now"), (7, "plain words"), (7, "x me@home.org"), (8, "x+1 555 010 9999@home.org end"), (9, "a@b.co, +1 555 010 9999; 10.0.0.1"), (10, None), (11, "")]
    docs = frame(spark, rows)
    got = pii.redact(docs)
    assert got.columns == docs.columns
    texts = sorted((r["doc_id"] or 0, r["text"] or "", r["best"]) for r in got.collect())
    assert [t for _, t, _ in texts] == ["mail [email] now", "nothing here", "plain words", "x [email]", "x[phone] end", "[email], [phone]; [ip]", "", ""]
    assert all(b == "z" for _, _, b in texts)


def test_awkward_rows_and_redaction(spark):
    docs = awkward(spark, [(8, "write to me@home.org soon"), (8, "write to me@home.org soon"), (None, "me@home.org")])
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == docs.count()
    assert sorted(r["n_email"] for r in got if r["doc_id"] == 8) == [1, 1]
    assert sum(r["n_email"] for r in got if r["doc_id"] is None) == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[8] == "write to [email] soon" and clean[1] is None
    assert pii.find(frame(spark, [])).count() == 0
