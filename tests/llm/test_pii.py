from __future__ import annotations

import hashlib
import random
import re

import pytest

from calltide.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(number: str) -> bool:
    digits = [int(c) for c in number][::-1]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def brute(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def base(text: str) -> list[tuple[str, int, int]]:
    return [(s.kind, s.start, s.end) for s in pii.scan(text) if s.kind in pii.BASE_KINDS]


@pytest.mark.parametrize("alphabet", ["a@.b", "12. 3", "4 -02", "+1 ()-.2", "a@.1-+ 4é"])
def test_base_spans_are_those_of_the_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
        assert base(text) == brute(text), text


def test_confirmed_kinds_and_context():
    text = "Card 4111 1111 1111 1111, iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, +1 (555) 010-9999, 10.0.0.256"
    kinds = [s.kind for s in pii.scan(text)]
    assert kinds == ["card", "iban", "ssn", "phone"]
    assert [s.kind for s in pii.scan("numbers 123-45-6789 here")] == []  # no context word
    assert [s.kind for s in pii.scan("GB83 WEST 1234 5698 7654 32")] == []  # mod-97 fails
    assert pii.redact("mail a@b.co now") == "mail [email] now"


def plain_account(country: str, n: int, rng: random.Random) -> str:
    """A valid account of n characters: the check digits that bring the number to 1 modulo 97."""
    own = "".join(rng.choice("0123456789ABZ") for _ in range(n - 4))
    number = lambda text: int("".join(str(int(c, 36)) for c in text))
    return f"{country}{98 - number(own + country + '00') % 97:02d}{own}"


def test_accounts_against_every_start_and_end():
    """The first start, from the left, at which a country's length gives a valid account that no letter or digit follows."""
    rng = random.Random(8)
    number = lambda text: int("".join(str(int(c, 36)) for c in text))
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            country = rng.choice(["DE", "GB", "NO", "FR"])
            account = plain_account(country, pii.IBAN_LENGTHS[country], rng)
            if rng.random() < 0.3:
                account = account[:4] + rng.choice("01234") + account[5:]  # most of these fail the check
            if rng.random() < 0.5:
                account = " ".join(account[k : k + 4] for k in range(0, len(account), 4))
            parts += [rng.choice(["pay", "TO", "12", "x1"]), account]
        text = rng.choice([" ", ", ", "\n"]).join([*parts, "end"])
        want, free = [], 0
        for start in range(len(text)):
            known = pii.IBAN_LENGTHS.get(text[start : start + 2])
            if start < free or not known or not text[start + 2 : start + 4].isdigit() or (start and text[start - 1].isalnum()):
                continue
            for end in range(start + known, min(len(text), start + 2 * known) + 1):
                own = text[start:end].replace(" ", "")
                if len(own) == known and own.isalnum() and own.upper() == own and "  " not in text[start:end] and not text[end - 1].isspace():
                    if not text[end : end + 1].isalnum() and number(own[4:] + own[:4]) % 97 == 1:
                        want.append((start, end))
                        free = end
                    break
        assert [a for a in pii.ibans(text) if text[a[0] : a[0] + 2] in pii.IBAN_LENGTHS] == want, text


def test_social_security_numbers_against_the_plain_pattern():
    rng = random.Random(9)
    for _ in range(2000):
        text = "ssn " + "".join(rng.choice("0123456789-- ") for _ in range(rng.randint(0, 40)))
        want = [
            m.span() for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text)
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000" and m.start() <= 40
        ]
        assert [(s.start, s.end) for s in pii.scan(text) if s.kind == "ssn" and s.start <= 40] == want


def test_time_is_linear_on_long_texts():
    for text in ("a" * 1_000_000 + "@", "1" * 1_000_000, "1." * 500_000, "+1" + " 1" * 500_000, "A" * 1_000_000, "@" * 500_000):
        pii.scan(text)


def test_summary(spark):
    rows = [(1, "x é a@b.co 4111111111111111"), (2, None), (3, ""), (1, "x é a@b.co 4111111111111111")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted(tuple(r) for r in pii.summary(df).collect())
    listed = "email:4:10,card:11:27"
    assert got[0] == got[1] == (1, 1, 0, 1, 0, hashlib.sha256(listed.encode()).hexdigest(), listed)
    assert got[2] == (2, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    assert pii.summary(df.limit(0)).count() == 0


DE, GB, NO = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"IBAN {DE} BIC COBADEFFXXX", [DE]), (f"{GB} USD 500", [GB]), (f"{DE} {GB} {NO}", [DE, GB, NO]), (f"{NO} 12 A", [NO]), (f"{GB}, then", [GB]),
        (f"AB12 {DE}", [DE]), (f"{DE}X", []), (f"{DE}x", []), (f"x{DE}", []), ("DE88370400440532013000 BIC", []), (f"{DE}é", [DE]), ("ZZ", []),
        ("XX57 1234 5678 9012 345 NEXT", ["XX57 1234 5678 9012 345"]),
    ],
)
def test_ibans_before_capitals_and_numbers(text, want):
    assert [text[s.start : s.end] for s in pii.scan(text) if s.kind == "iban"] == want


def test_time_of_ibans_is_linear():
    for text in ("AB12 " * 200_000, "DE89 3704 0044 0532 0130 00 " * 40_000, "ZZ12" + " A" * 500_000):
        pii.scan(text)


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "x@y.zz"), (None, None)], "name string, text string")
    assert sorted((r.doc_id or "", r.n_email) for r in pii.summary(df, doc_id="name").collect()) == [("", 0), ("a", 1)]
