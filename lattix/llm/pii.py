"""Format-preserving pseudonyms for personal data, in DataFrame and SQL functions only.

One regular expression finds the candidates of a text; each is validated by kind (Luhn, mod 97, calendar, octets, number
plan) and replaced by a keyed Feistel permutation of its own format, so equal values get equal pseudonyms in all
documents and different values stay different:

* ``card``   first digit kept, other payload digits permuted, check digit computed anew; separators stay
* ``iban``   country kept, letters and digits permuted within their class, check digits computed anew; as long as the
             country's are, of unlisted countries as far as groups go, so that a next word may hide a valid one
* ``date``   the day is permuted within the 400 years 1800-2199; the layout stays
* ``ip``     all 2^32 addresses
* ``ssn``    all valid area, group and serial numbers
* ``phone``  country and area code kept, exchange and line permuted; other numbers: digits after the country code
* ``email``  letters and digits of the local part and of the domain's labels, but for the last
* ``secret`` the assigned value; hexadecimal stays hexadecimal

Round functions are SHA-256 with the caller's key; eight rounds. What isn't valid stays as it is. No join, no shuffle, no
Python. Defined cases: a null text stays null, with no findings; an empty or very long text is treated like any other;
repeated rows each get their row; an empty table gives no rows; of candidates that begin in one place the kind listed first
is tried first (a tie); other columns pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("secret", "email", "iban", "date", "ip", "card", "ssn", "phone")
ROUNDS = 8
TEST_KEY = "lattix-test-key"

_IBAN_COUNTRIES = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}  # by length
_IBAN = "|".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"(?: ?[A-Z0-9]{{{(n - 4) % 4}}})" if n % 4 else "") for n, c in _IBAN_COUNTRIES.items())
_ASSIGNED = r"""(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?"""
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9]){_ASSIGNED}(?=[A-Za-z_+/.=~-]*\d)[A-Za-z0-9_+/.~-][A-Za-z0-9_+/.=~-]{{6,}}[A-Za-z0-9_+/=~-]",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d|-\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d+(-])(?:(?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])[2-9]\d{2}[ .-]\d{4}|\+1[ .-]?\d{3} [2-9]\d{2}[ .-]\d{4}|\+(?!1)\d{1,3}[ .-]\(?\d\)?(?:[ .-]?\d{2,4}){2,5}|\+(?!1)\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4})(?![\d]|-\d)",
}


def _pattern() -> str:
    """All kinds in one; back references get their numbers in the whole."""
    out, groups = [], 0
    for kind in KINDS:
        p = PATTERNS[kind]
        own = 2 if kind == "card" else 0
        for k in range(own, 0, -1):
            p = p.replace(f"\\{k}", f"\\{k + groups}")
        groups += own
        out.append(p)
    return "|".join(out)


PATTERN = _pattern()
_DAYS = 146_097  # of 400 years, 27 x 5411
_FIRST = "DATE'1800-01-01'"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Sql:
    """SQL for one match ``m``; variables of nested lambdas have names of their own."""

    def __init__(self, key: str):
        self.key = _lit(key)

    def noise(self, label: str, *parts: str) -> str:
        return f"CAST(conv(substring(sha2(concat_ws('|', {self.key}, '{label}', {', '.join(f'CAST({p} AS STRING)' for p in parts)}), 256), 1, 12), 16, 10) AS BIGINT)"

    def numbers(self, a: str, b: str, size_a: int, size_b: int, label: str, result: str) -> str:
        """Permutation of Z_a x Z_b; result: SQL of ``t.a`` and ``t.b``."""
        return (
            f"aggregate(sequence(1, {ROUNDS}), struct(CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b), "
            f"(t, r) -> IF(r % 2 = 1, struct((t.a + {self.noise(label, 'r', 't.b')}) % {size_a} AS a, t.b AS b), struct(t.a AS a, (t.b + {self.noise(label, 'r', 't.a')}) % {size_b} AS b)), t -> {result})"
        )

    def shifted(self, text: str, other: str, label: str, hexadecimal: bool) -> str:
        noise = self.noise(label, "r", "i", "o")

        def turn(alphabet: str) -> str:
            return f"substring('{alphabet}', CAST((instr('{alphabet}', c) - 1 + {noise}) % {len(alphabet)} AS INT) + 1, 1)"

        classes = [("[0-9a-f]", "0123456789abcdef")] if hexadecimal else [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
        turned = f"array_join(transform(filter(split({text}, ''), e -> e != ''), (c, i) -> CASE {' '.join(f'WHEN c RLIKE {_lit(p)} THEN {turn(x)}' for p, x in classes)} ELSE c END), '')"
        return self.let("o", f"IF(length({other}) > 100, sha2({other}, 256), {other})", turned)  # work doesn't grow with the square of a long secret

    def characters(self, v: str, label: str, hexadecimal: bool = False) -> str:
        """Permutation of the strings with the same class of character in each place."""
        return (
            f"aggregate(sequence(1, {ROUNDS}), struct(substring({v}, 1, length({v}) div 2) AS a, substring({v}, length({v}) div 2 + 1) AS b), "
            f"(t, r) -> IF(r % 2 = 1, struct({self.shifted('t.a', 't.b', label, hexadecimal)} AS a, t.b AS b), struct(t.a AS a, {self.shifted('t.b', 't.a', label, hexadecimal)} AS b)), t -> concat(t.a, t.b))"
        )

    def let(self, name: str, value: str, body: str) -> str:
        """body with name bound to value, which is computed once."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    @staticmethod
    def digits(v: str) -> str:
        return f"regexp_replace({v}, '[^0-9]', '')"

    @staticmethod
    def luhn(d: str, doubled: int) -> str:
        """Sum of the digits; from the right, every second is doubled, the last if doubled = 0."""
        return f"aggregate(transform(split(reverse({d}), ''), (c, i) -> IF(c = '', 0, IF(i % 2 = {doubled}, (CAST(c AS INT) * 2) % 10 + (CAST(c AS INT) * 2) div 10, CAST(c AS INT)))), CAST(0 AS BIGINT), (s, x) -> s + x)"

    @staticmethod
    def mod97(v: str) -> str:
        """Of an IBAN without blanks: the first four characters last, letters as 10 to 35."""
        return f"aggregate(split(concat(substring({v}, 5), substring({v}, 1, 4)), ''), 0, (s, c) -> CASE WHEN c = '' THEN s WHEN c RLIKE '[0-9]' THEN (s * 10 + CAST(c AS INT)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END)"

    @staticmethod
    def laid_out(like: str, chars: str) -> str:
        """chars (digits or letters) in the places of the digits and letters of like."""
        return f"aggregate(filter(split({like}, ''), e -> e != ''), struct('' AS s, 1 AS n), (t, c) -> IF(c RLIKE '[0-9A-Za-z]', struct(concat(t.s, substring({chars}, t.n, 1)) AS s, t.n + 1 AS n), struct(concat(t.s, c) AS s, t.n AS n)), t -> t.s)"

    def kind(self, m: str) -> str:
        full = {k: f"{m} RLIKE {_lit('^(?:' + PATTERNS[k] + ')$')}" for k in KINDS}
        valid = {
            "iban": f"{self.mod97(f"replace({m}, ' ', '')")} = 1",
            "card": f"{self.luhn(self.digits(m), 1)} % 10 = 0",
            "date": f"year({self.day(m)}) BETWEEN 1800 AND 2199",
        }
        return "CASE " + " ".join(f"WHEN {full[k]} AND coalesce({valid[k]}, false) THEN '{k}'" if k in valid else f"WHEN {full[k]} THEN '{k}'" for k in KINDS) + " END"

    @staticmethod
    def layout(m: str) -> str:
        """Day first where the parts are divided by points; month first with slashes, unless that is no date."""
        return f"CASE WHEN {m} LIKE '%-%' THEN 'yyyy-MM-dd' WHEN {m} LIKE '%.%' THEN 'dd.MM.yyyy' WHEN try_to_timestamp({m}, 'MM/dd/yyyy') IS NOT NULL THEN 'MM/dd/yyyy' ELSE 'dd/MM/yyyy' END"

    def day(self, m: str) -> str:
        return f"CAST(coalesce(try_to_timestamp({m}, 'yyyy-MM-dd'), try_to_timestamp({m}, 'dd.MM.yyyy'), try_to_timestamp({m}, 'MM/dd/yyyy'), try_to_timestamp({m}, 'dd/MM/yyyy')) AS DATE)"

    def pseudonym(self, m: str, kind: str) -> str:
        if kind == "secret":
            value = f"regexp_extract({m}, {_lit('^' + _ASSIGNED + '(.*)$')}, 1)"
            body = f"concat(substring({m}, 1, length({m}) - length(v)), IF(v RLIKE '^[0-9a-f]+$', {self.characters('v', 'hex', True)}, {self.characters('v', 'secret')}))"
            return self.let("v", value, body)
        if kind == "email":
            labels = f"transform(split(regexp_extract({m}, '@(.*)[.][^.]*$', 1), '[.]'), w -> {self.characters('w', 'domain')})"
            return f"concat({self.let('v', f'substring_index({m}, {_lit('@')}, 1)', self.characters('v', 'local'))}, '@', array_join({labels}, '.'), '.', substring_index({m}, '.', -1))"
        if kind == "iban":
            plain = f"replace({m}, ' ', '')"
            made = f"concat(substring(v, 1, 2), '00', {self.let('w', 'substring(v, 5)', self.characters('w', 'iban'))})"
            checked = self.let("y", made, f"concat(substring(y, 1, 2), lpad(CAST(98 - {self.mod97('y')} AS STRING), 2, '0'), substring(y, 5))")
            return self.let("v", plain, self.let("x", checked, self.laid_out(m, "x")))
        if kind == "date":
            days = f"datediff({self.day(m)}, {_FIRST})"
            made = self.numbers("v div 5411", "v % 5411", 27, 5411, "date", "t.a * 5411 + t.b")
            return self.let("v", days, f"date_format(date_add({_FIRST}, CAST({made} AS INT)), {self.layout(m)})")
        if kind == "ip":
            part = lambda k: f"CAST(element_at(split({m}, '[.]'), {k}) AS BIGINT)"
            out = "concat_ws('.', CAST(t.a div 256 AS STRING), CAST(t.a % 256 AS STRING), CAST(t.b div 256 AS STRING), CAST(t.b % 256 AS STRING))"
            return self.numbers(f"{part(1)} * 256 + {part(2)}", f"{part(3)} * 256 + {part(4)}", 65536, 65536, "ip", out)
        if kind == "card":
            payload = "concat(substring(v, 1, 1), " + self.let("w", "substring(v, 2, length(v) - 2)", self.characters("w", "card")) + ")"
            checked = self.let("y", payload, f"concat(y, CAST((10 - {self.luhn('y', 0)} % 10) % 10 AS STRING))")
            return self.let("v", self.digits(m), self.let("x", checked, self.laid_out(m, "x")))
        if kind == "ssn":
            d = f"CAST(substring({m}, 1, 3) AS BIGINT)"
            area = f"{d} - IF({d} > 666, 2, 1)"
            rest = f"(CAST(substring({m}, 5, 2) AS BIGINT) - 1) * 9999 + CAST(substring({m}, 8, 4) AS BIGINT) - 1"
            out = "concat(lpad(CAST(t.a + IF(t.a >= 665, 2, 1) AS STRING), 3, '0'), '-', lpad(CAST(t.b div 9999 + 1 AS STRING), 2, '0'), '-', lpad(CAST(t.b % 9999 + 1 AS STRING), 4, '0'))"
            return self.numbers(area, rest, 898, 99 * 9999, "ssn", out)
        if kind == "phone":
            tail = f"substring({m}, length({m}) - 7)"  # nnn-nnnn
            out = f"concat(substring({m}, 1, length({m}) - 8), CAST(t.a + 200 AS STRING), substring({tail}, 4, 1), lpad(CAST(t.b AS STRING), 4, '0'))"
            national = self.numbers(f"CAST(substring({tail}, 1, 3) AS BIGINT) - 200", f"CAST(substring({tail}, 5, 4) AS BIGINT)", 800, 10_000, "phone", out)
            head = f"regexp_extract({m}, '^[+][0-9]{{1,3}}', 0)"
            abroad = self.let("v", f"substring({m}, length({head}) + 1)", f"concat({head}, {self.characters('v', 'phone')})")
            return f"IF({m} RLIKE '^[+][02-9]', {abroad}, {national})"
        raise ValueError(kind)

    def replaced(self, m: str) -> str:
        """struct(kind, as it stands afterwards)"""
        return self.let("k", self.kind(m), f"struct(k AS kind, CASE k {' '.join(f'WHEN {_lit(x)} THEN {self.pseudonym(m, x)}' for x in KINDS)} ELSE {m} END AS value)")


def findings(text: str, key: str) -> Column:
    """Of each candidate in its order: kind (null: not valid) and what stands in its place afterwards."""
    return F.expr(f"CASE WHEN `{text}` RLIKE '[0-9@]' THEN transform(regexp_extract_all(`{text}`, {_lit(PATTERN)}, 0), m -> {_Sql(key).replaced('m')}) END")


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str = TEST_KEY, found: str | None = None) -> DataFrame:
    """The documents with pseudonyms in ``text``; with ``found``, also a column of (kind, value) of the replaced. Give a key of your own, kept secret."""
    name = found or "_pii"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    named = docs.withColumn(name, findings(text, key))
    parts = f"split(`{text}`, {_lit(PATTERN)}, -1)"
    made = F.expr(f"CASE WHEN size(`{name}`) > 0 THEN array_join(zip_with({parts}, `{name}`, (p, x) -> concat(p, coalesce(x.value, ''))), '') ELSE `{text}` END")
    valid = F.expr(f"coalesce(filter(`{name}`, x -> x.kind IS NOT NULL), array())")
    out = [made.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return named.select(*out, *([valid.alias(name)] if found else []))


def digest(docs: DataFrame, *, key: str = TEST_KEY) -> DataFrame:
    done = pseudonymise(docs.select("doc_id", "text"), key=key, found="pii")
    counts = [F.expr(f"CAST(size(filter(pii, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *counts, F.array_sort(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["value"]))).alias("pseudonyms"))
