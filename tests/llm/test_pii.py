import hashlib
import random
import re

import pytest

from quillforge.llm.pii import KINDS, added_spans, base_spans, find_pii, luhn, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    n = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(n(m[0])) <= 19 and luhn(n(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(n(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_equals_the_patterns():
    rng = random.Random(2)
    for _ in range(30_000):
        text = "".join(rng.choice(["a", "@", ".", "1", "25", " ", "-", "+", "(", ")", "é", "_", "4111111111111111", "٣", "b.c", "300"]) for _ in range(rng.randrange(1, 25)))
        assert base_spans(text) == brute(text), text


def found(text):
    return [(k, text[a:b]) for k, a, b in added_spans(text, base_spans(text))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to john.doe (at) example (dot) com now", [("email", "john.doe (at) example (dot) com")]),
        ("é jane dot doe at mail dot example dot org.", [("email", "jane dot doe at mail dot example dot org")]),
        ("x[at]y.de, z @ w", [("email", "x[at]y.de")]),
        ("user@example[.]com", [("email", "user@example[.]com")]),
        ("jоhn@example.com", [("email", "jоhn@example.com")]),
        ("ｊｏｅ＠ｅｘ．ｏｒｇ!", [("email", "ｊｏｅ＠ｅｘ．ｏｒｇ")]),
        ("four one one one one one one one one one one one one one one one ok", [("card", "four one one one one one one one one one one one one one one one")]),
        ("call plus one five five five two three four five six seven eight", [("phone", "plus one five five five two three four five six seven eight")]),
        ("10 dot 0 dot 0 dot 7 and 192[.]168[.]1[.]300", [("ip", "10 dot 0 dot 0 dot 7")]),
        ("look at example.com or at home, one two three", []),
        ("fullwidth ４１１１ １１１１ １１１１ １１１１.", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("a​b@c.d", [("email", "a​b@c.d")]),
        ("Größe @ 12 at 5 dot 3", []),
    ],
)
def test_disguises(text, want):
    assert found(text) == want


def test_plain_text_adds_nothing():
    rng = random.Random(4)
    for _ in range(2000):
        text = " ".join(rng.choice(["at", "dot", "the", "one", "point", "a@b.cc", "Größe", "un", "point,", "2", "1.2.3.4"]) for _ in range(12))
        assert all(("dot" in x or "point" in x) for _, x in found(text)), text
    assert found("a" * 200_000 + " " + "9" * 200_000 + "<" * 10_000 + "one " * 5) == []


def test_redaction_and_defined_results(spark):
    rows = [(1, "mail a@b.cc or x (at) y (dot) zz", "own"), (1, "mail a@b.cc or x (at) y (dot) zz", "own"), (2, None, None), (3, "", ""), (None, "+1 555 123 4567", "x")]
    got = {(r.doc_id, r.text): r for r in find_pii(spark.createDataFrame(rows, "doc_id int, text string, spans string")).collect()}
    assert got[1, rows[0][1]].pii_redacted == "mail [EMAIL] or [EMAIL]"
    assert got[2, None].pii_redacted is None and got[2, None].pii_base == []
    assert got[None, "+1 555 123 4567"].pii_redacted == "[PHONE]" and len(got) == 4
    assert redact("abcdef", [("ip", 1, 3), ("card", 2, 4)]) == "a[IP]ef"


def test_query_digest(spark, tmp_path):
    from quillforge.llm.pii import op7_deobfuscation

    text = "é a@b.cc 1.2.3.4 u (at) v.ww"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op7_deobfuscation(spark, str(tmp_path)).collect()}
    assert rows[1].base_sha256 == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()
    assert rows[1].spans == "email:2:8,ip:9:16,email:17:28" and rows[1].n_email == 2
    assert rows[2].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("at one nine two dot one six eight dot zero dot one now", [("ip", "one nine two dot one six eight dot zero dot one")]),
        ("at 192 dot one six eight dot 0 dot one now", [("ip", "192 dot one six eight dot 0 dot one")]),
        ("at one nine two.one six eight.zero.one", [("ip", "one nine two.one six eight.zero.one")]),
        ("call +49 one seven zero 1234567 now", [("phone", "+49 one seven zero 1234567")]),
        ("call plus four nine (one seven zero) one two three four five six", [("phone", "plus four nine (one seven zero) one two three four five six")]),
        ("pay four one one one 1111 1111 1111 now", [("card", "four one one one 1111 1111 1111")]),
        ("pay 4111 1111 1111 111 one", [("card", "4111 1111 1111 111 one")]),
        ("write to john @ example.com or jane@ example.org", [("email", "john @ example.com"), ("email", "jane@ example.org")]),
        ("x (at) example (dot) one and un", [("email", "x (at) example (dot) one")]),
        ("+1 555 123 4567. One of 12345678901 or 10. Two", []),
        ("one, two, three, four and 1999, un an", []),
    ],
)
def test_spelled_digits_in_any_run(text, want):
    assert found(text) == want


def test_parts_of_any_length_are_found():
    local, label = "x" * 300 + ".y", "z" * 90
    text = f"write to {local} dot q (at) {label} dot {'sub dot ' * 12}example dot org now"
    (kind, a, b), = added_spans(text, base_spans(text))
    assert kind == "email" and text[a:b].startswith(local) and text[a:b].endswith("example dot org")
    assert added_spans("dot (at) nothing", []) == [] and added_spans(" dot x (at) host dot org", []) == [("email", 5, 24)]
