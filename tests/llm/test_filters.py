"""URL filter, PII and WARC: contracts, brute force, round trips, odd input."""

import hashlib
import math
import time
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from foldlake.llm import pii, warc
from foldlake.llm.op1_query import RULES
from foldlake.llm.op2_query import op2_pii
from foldlake.llm.url_filter import domain_of, judge_urls, prior_strength, site_of, suffix_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CASES = [
    (1, "Mail a.b@ex.org and a@b, a@@b.c_d@e.f.g now", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0),
    (4, "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4", "en", "s", 1), (5, "card 4539 1488 0343 6467 and 4539-1488-0343-6468 1234567890123", "en", "s", 1),
    (6, "call +1 (386) 555-3733 or +12 34 or +1.2.3.4.5.6.7.8.9.0.1.2", "en", "s", 1), (6, "call +1 (386) 555-3733 or +12 34 or +1.2.3.4.5.6.7.8.9.0.1.2", "en", "s", 1),
    (7, "éü😀 x@y.zz 😀 9.9.9.9", "en", "s", 1), (None, "null id q@r.st", "en", "s", 1), (8, "a" * 200_000 + "@" + "b." * 5000 + "c " + "1" * 50_000, "en", "s", 1),
]
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(float(x) <= 255 for x in m.split("."))
    if kind == "card":
        values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in values) % 10 == 0
    return 10 <= len(d) <= 15 if kind == "phone" else True


def _spans(text):
    out = []
    for i, (k, p) in enumerate(BASE):
        # a long run without @ is quadratic in the plain pattern; it can only match from its start
        found = re.finditer(r"(?<![A-Za-z0-9._%+-])" + p if k == "email" and len(text) > 10_000 else p, text)
        out += [(m.start(), i, m.end(), k) for m in found if _ok(k, m.group())]
    return sorted(out)


def test_pii_is_brute_force(spark, tmp_path):
    spark.createDataFrame(CASES, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(CASES)
    by = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got}
    for doc, text, *_ in CASES:
        s = _spans(text or "")
        n = [sum(x[3] == k for x in s) for k, _ in BASE]
        assert (doc, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest(), *n) in by, doc


def test_disclosing_terms_are_removed(spark):
    rows = [(i, f"filler{i} words unlike others{i} wrote Zanzibarix to boss@corp.org about matter{i}") for i in range(6)] + [(100 + i, f"plain text number{i} wrote about things") for i in range(60)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("boss@" not in clean[i] and "Zanzibarix" not in clean[i] and "wrote" in clean[i] for i in range(6))
    assert all(clean[100 + i] == f"plain text number{i} wrote about things" for i in range(60))


def test_disclosing_terms_go_everywhere(spark):
    far = "so it went on " * 40
    rows = [(i, f"filler{i} words unlike others{i} wrote Zanzibarix to boss@corp.org about matter{i}") for i in range(6)] + [(100 + i, f"plain text number{i} wrote about things") for i in range(200)]
    rows += [(50, f"İ asked boss@corp.org then {far} İ met Zanzibarix, ZANZIBARIX and Zanzibarixes"), (51, "nobody else wrote like zanzibarix"), (51, "nobody else wrote like zanzibarix"), (None, "Zanzibarix")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = sorted((r.doc_id or 0, r.text) for r in pii.sanitise(docs).filter("doc_id is null or doc_id in (50, 51)").collect())
    assert clean == [(0, "<name>"), (50, f"İ asked <email> then {far} İ met <name>, <name> and Zanzibarixes"), (51, "nobody else wrote like <word>"), (51, "nobody else wrote like <word>")]
    found = {r.doc_id: r.terms for r in pii.find_pii(docs).collect()}
    text = rows[-4][1]
    assert [text[s["start"] : s["end"]] for s in found[50]] == ["Zanzibarix", "ZANZIBARIX"] and len(found[51]) == len(found[None]) == 1 and found[100] == []


WORD = regex.compile(r"\p{L}{4,}")


def _plain_disclosure(rows, window=60, at=0.8):
    """(entity, term) to (n_et, n_e, n_t, disclosure), and (id, text) to the spans of its disclosing terms, in plain Python."""
    docs = {(i, t or "") for i, t in rows}
    near, contexts, having = {}, {}, {}
    for doc in docs:
        text, base = doc[1], _spans(doc[1])
        for start, _, end, kind in base:
            value = text[start:end].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[start:end])
            entity = f"{kind}:{value}"
            left, right = max(0, start - window), min(len(text), end + window)
            having.setdefault(entity, set()).add(doc)
            for a, b, open_left, open_right in ((left, start, left > 0, True), (end, right, True, right < len(text))):
                for m in WORD.finditer(text[a:b]):
                    cut_off = (open_left and m.start() == 0) or (open_right and m.end() == b - a)
                    if not cut_off and not any(x[0] < a + m.end() and a + m.start() < x[2] for x in base):
                        key = entity, m.group().lower()
                        near.setdefault(key, set()).add(doc)
                        contexts.setdefault(key, set()).add((text[left:start] + "\n" + text[end:right]).lower())
    said = {}
    for doc in docs:
        for w in {w.lower() for w in WORD.findall(doc[1])}:
            said.setdefault(w, set()).add(doc)
    pairs = {}
    for (entity, term), found in near.items():
        n_et, n_e, n_t, n = len(found), len(having[entity]), len(said[term]), len(docs)
        if len(contexts[entity, term]) >= 2 and n > n_e:
            value = round(math.log(n_et * n / (n_e * n_t)) / math.log(n / n_e), 9)
            if value >= at:
                pairs[entity, term] = n_et, n_e, n_t, value
    terms, spans = {t for _, t in pairs}, {}
    for doc in docs:
        base = _spans(doc[1])
        spans[doc] = [(m.start(), m.end()) for m in WORD.finditer(doc[1]) if m.group().lower() in terms and not any(x[0] < m.end() and m.start() < x[2] for x in base)]
    return pairs, spans


def test_disclosure_is_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "Bravo", "çharlie", "delta", "echoes", "of", "a", "Zanzibarix", "QUUX", "İvory", "tango"]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        if i % 4 == 0:
            text += f" İ Smithson{'abc'[i % 3]} wrote from smith{i % 3}@corp.org{'.' * (i % 2)} Kontakt{'abc'[i % 3]} " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 20)))
        if i % 10 == 0:
            text += f" at 10.0.0.{i % 2} Hostmaster{'xy'[i % 2]} " + "padding " * 12 + f"Smithson{'abc'[i % 3]}"
        rows.append((i, text))
    rows += rows[:20] + [(None, rows[0][1]), (None, None), (3, ""), (3, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, spans = _plain_disclosure(rows)
    got = pii.disclosing_terms(docs, pii.base_table(docs)).collect()
    assert {(r.entity, r.term): (r.n_et, r.n_e, r.n_t, r.disclosure) for r in got} == want and len(want) > 4
    found = sorted((str(r.doc_id), [(s["start"], s["end"]) for s in r.terms]) for r in pii.find_pii(docs).collect())
    assert found == sorted((str(i), spans[i, t or ""]) for i, t in rows) and any(s for _, s in found)


def test_bare_mentions_count(spark):
    rows = [(i, f"by{i} Zanzibarix to boss@corp.org at {i}") for i in range(6)] + [(50 + i, f"{i} boss@corp.org") for i in range(20)] + [(100 + i, "none") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = pii.disclosing_terms(docs, pii.base_table(docs)).collect()
    assert [(p.term, p.n_et, p.n_e, p.n_t) for p in pairs] == [("zanzibarix", 6, 26, 6)]


def test_sanitise_keeps_columns(spark):
    d = spark.createDataFrame([(1, "x a@b.cd y", "keep", 7)], "doc_id long, text string, _base string, entity int")
    assert pii.sanitise(d).collect() == [(1, "x <email> y", "keep", 7)]
    assert pii.sanitise(spark.createDataFrame(CASES[:2], DOCS).filter("doc_id > 9")).collect() == []


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/1", "http://www.example.com/en/1", "http://x.com/a?b", "http://x.com?b", "https://n.net/fr/#x", "http://n.net/de/", "nourl", "", "://", None, "http://xcom/"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h"), (0, urls[0], "h")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == ("a.example.com", "/en/1", "example.com/en/", "block") == by[None]
    assert by[1][2:] == ("www.example.com/en/", "allow") and by[2][2:] == ("com/", "allow") and by[3][:3] == ("x.com", "", None)
    assert by[4][1:] == ("/fr/", "net/fr/", "block") and by[5][2] is None and by[6][:3] == by[7][:3] == by[8][:3] == by[9][:3] == ("", "", None)
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def test_reputation_shrinks(spark):
    rows = [(i, f"http://bad.evil.org/{i}", 1) for i in range(40)] + [(100 + i, f"http://h{i}.good.org/{i}", 0) for i in range(60)] + [(200, "http://bad.evil.org/new", None), (201, "http://other.good.org/", None), (202, "http://nowhere.xyz/", None)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, bad int"), [], bad=F.col("bad")).collect()}
    assert got[200].verdict == "block" and got[201].verdict == "allow" and got[202].verdict == "allow"


def test_prior_strength():
    same = {"g": 10.0, "n": 100.0, "k": 50.0, "q": 25.0}
    assert prior_strength(same, {"g": 1.0, "n": 100.0, "k": 50.0, "q": 25.0}) == 10.0
    apart = {"g": 10.0, "n": 100.0, "k": 50.0, "q": 50.0}
    assert prior_strength(apart, {"g": 1.0, "n": 100.0, "k": 50.0, "q": 25.0}) == 0.5


def test_doubt_is_handed_down(spark):
    """Two bad suffixes of many bad pages do not condemn an unseen one; a bad domain does condemn its new hosts."""
    rows = [(i, f"http://h{i % 8}.d{i % 40}.{('net', 'biz')[i % 2]}/", 1) for i in range(400)] + [(1000 + i, f"http://good{i}.d{i}.net/", 0) for i in range(9)]
    rows += [(2000, "http://new.d1.biz/", None), (2001, "http://new.d999.biz/", None), (2002, "http://new.unseen/", None), (2003, "http://u@h1.d1.biz:8080/", None)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, bad int"), [], bad=F.col("bad")).filter("page_id >= 2000").collect()}
    assert {i: r.verdict for i, r in got.items()} == {2000: "block", 2001: "block", 2002: "allow", 2003: "block"}
    assert got[2000].lower > got[2001].lower > 0.5 > got[2002].lower and got[2003].host == "u@h1.d1.biz:8080"


def test_domains(spark):
    rows = [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("10.1.2.3", "10.1.2.3", "10.1.2.3"), ("[::1]", "[::1]", "[::1]"), ("x.y.example.com", "example.com", "com"), ("local", "local", "local"), ("", "", "")]
    df = spark.createDataFrame(rows, "site string, d string, s string")
    assert df.filter((domain_of(F.col("site")) != F.col("d")) | (suffix_of(F.col("site")) != F.col("s"))).collect() == []
    assert df.limit(1).select(site_of(F.lit("u:p@a.com:80")), site_of(F.lit("a.com"))).first()[:] == ("a.com", "a.com")


def test_equal_rules_tie_by_order(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert judge_urls(df, [("a.com", "/", "block"), ("a.com", "/", "allow")]).first().verdict == "allow"


def test_warc_round_trip(spark):
    big = "x" * 1500 + "é"
    rows = [(1, "http://a/", "<p>small</p>", "e"), (2, None, big, "e"), (3, "u\r\nbad: header", big, "e"), (3, "u", big, "e"), (None, "u", big, "e"), (4, "u", None, "e"), (5, "u", "<p>small</p>", "e"), (6, "u", "y" * 3_000_000, "e")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, error string")).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    for i, _, html, _ in rows:
        p = (html or "").encode()
        kind = ("revisit", 3) if html == big and i != 3 else ("response", None)
        assert (i, len(p), hashlib.sha1(p).hexdigest(), *kind) in {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got}
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_warc_damage():
    a = warc.Archive()
    for i in range(20):
        p = f"<p>{i}</p>".encode() * 50
        a.add(warc.record(i, "http://x/", p, hashlib.sha1(p).hexdigest(), None, False, "1970-01-01T00:00:00Z"))
    data = a.content()
    every = list(warc.frames(data))
    assert len(every) == 20 and [warc.parse(r)["page_id"] for r in every] == list(range(20))
    for bad in (data[4:], data[:-5], data + b"junkjunk", data[:-3] + b"abc"):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    for bad in (every[0][:-1], every[0] + b"x", every[0].replace(b"WARC/1.1", b"WARC/9.9"), every[0].replace(b"<p>0", b"<p>1"), every[0].replace(b"Content-Length: 4", b"Content-Length: 5", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_words_beside_addresses_and_private_characters(spark):
    odd = ["ééééémile@corp.org wörtlich", "x+1234567890123abcdef Wörterfünf", "@corp.org Jahre", "a.b@c.de.f@g.hi Nachbar", "4111 1111 1111 1111 Karte karte@x.yz-Teil", "1.2.3.4@corp.org Zifferblatt 1.2.3.4 Ende"]
    rows = [(i, f"{odd[i % len(odd)]} boss@corp.org Ufer{'ab'[i % 2] * 3} {i}") for i in range(24)] + [(100 + i, f"nothing {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, spans = _plain_disclosure(rows)
    got = pii.disclosing_terms(docs, pii.base_table(docs)).collect()
    assert {(r.entity, r.term): (r.n_et, r.n_e, r.n_t, r.disclosure) for r in got} == want and want
    assert all([(s["start"], s["end"]) for s in r.terms] == spans[r.doc_id, dict(rows)[r.doc_id]] for r in pii.find_pii(docs).collect())


def test_very_many_mentions_in_one_text(spark):
    def text(n):
        return " ".join(f"Wort{i % 7}x name{i}@mail{i % 50}.org" for i in range(n))

    took = {}
    for n in (500, 8000):  # the first also warms up
        docs = spark.createDataFrame([(1, text(n)), (2, text(50))], "doc_id long, text string")
        began = time.time()
        base = pii.base_table(docs)
        took[n] = time.time() - began
        row = base.filter("doc_id = 1").first()
        assert row.n_email == n and len(row._mentions) == n
        assert [(s["start"], s["end"]) for s in row._base] == [(a, b) for a, _, b, _ in _spans(text(n))]
    assert took[8000] < 15
    clean = pii.sanitise(docs).filter("doc_id = 1").first().text
    assert clean.count("<email>") == 8000 and "@" not in clean and clean.startswith("Wort0x <email> Wort1x <email>")
