"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers, dates and mail names are permuted by a keyed Feistel network within their own format: a card number
becomes a card number with a right check digit and the same separators, a date another date of the same century. The
permutation depends on the key, the kind and the value alone, so equal values get equal pseudonyms in all documents, and
different values different ones.

Numbers are pairs (a, b) below fixed moduli (A, B); ten rounds add a keyed hash of one half to the other, modulo its size.
Domains that are no product of round numbers are cut so that they are: a century has 36,524 = 92 x 397 or 36,525 = 75 x 487
days. Mail names are pairs of strings, in which a round shifts every letter and digit within its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

ROUNDS = 10

# The forms that are looked for, first match first. All are bounded, so no form backtracks far.
_FREE, _ENDS = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": _FREE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _ENDS,
    "date": _FREE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _ENDS,
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": _FREE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _ENDS,
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})" + _ENDS,
}
PATTERN = "|".join(FORMS.values())


def _hash(key: Column, tweak: Column, i: Column, x: Column) -> Column:
    """60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", key, tweak, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def _feistel(key: Column, tweak: Column, a: Column, b: Column, mod_a: Column, mod_b: Column) -> Column:
    """The permuted pair as a struct (a, b); each half stays below its modulus."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(F.pmod(s["a"] + _hash(key, tweak, i, s["b"]), mod_a).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), F.pmod(s["b"] + _hash(key, tweak, i, s["a"]), mod_b).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _pad(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _digits(key: Column, tweak: Column, d: Column) -> Column:
    """A string of 2 to 30 digits, permuted among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    return _let(
        _feistel(key, F.concat(tweak, n.cast("string")), F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, n - u).cast("long"), _ten(u), _ten(n - u)),
        lambda s: F.concat(_pad(s["a"], u), _pad(s["b"], n - u)),
    )


def _chars(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))


def _only(x: Column, what: str) -> Column:
    return F.regexp_replace(x, f"[^{what}]", "")


def _fill(form: Column, d: Column) -> Column:
    """form with its digits taken from d in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(d, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))
        )

    return F.aggregate(_chars(form), start, put)["out"]


def _luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits."""
    n = F.length(d)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(d, i, F.lit(1)).cast("int") * (1 + (n - i) % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def _card(key: Column, m: Column) -> Column:
    def swap(d: Column) -> Column:
        n = F.length(d)
        kept = F.substring(d, 1, 1)
        body = F.concat(kept, _digits(key, F.concat(F.lit("card"), kept), F.substring(d, F.lit(2), n - 2)))
        done = _let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when((n >= 13) & (n <= 19) & (_luhn(d) % 10 == 0), _fill(m, done)).otherwise(m)

    return _let(_only(m, "0-9"), swap)


def _phone(key: Column, m: Column) -> Column:
    def national(d: Column) -> Column:
        """Ten digits. Numbers with a valid area and exchange (200 and up) stay so; the others keep to themselves."""
        area, middle, line = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        high, low = F.floor(line / 100), line % 100
        right = _let(
            _feistel(key, F.lit("phone"), (area - 200) * 100 + high, (middle - 200) * 100 + low, F.lit(80000), F.lit(80000)),
            lambda s: F.concat(_pad(F.floor(s["a"] / 100) + 200, F.lit(3)), _pad(F.floor(s["b"] / 100) + 200, F.lit(3)), _pad(s["a"] % 100, F.lit(2)), _pad(s["b"] % 100, F.lit(2))),
        )
        no_area = _let(
            _feistel(key, F.lit("phone-area"), area * 1000 + middle, line, F.lit(200000), F.lit(10000)),
            lambda s: F.concat(_pad(s["a"], F.lit(6)), _pad(s["b"], F.lit(4))),
        )
        no_middle = _let(
            _feistel(key, F.lit("phone-exchange"), (area - 200) * 200 + middle, line, F.lit(160000), F.lit(10000)),
            lambda s: F.concat(_pad(F.floor(s["a"] / 200) + 200, F.lit(3)), _pad(s["a"] % 200, F.lit(3)), _pad(s["b"], F.lit(4))),
        )
        return F.when(area < 200, no_area).when(middle < 200, no_middle).otherwise(right)

    def swap(d: Column) -> Column:
        n = F.length(d)
        code = F.substring(d, 1, 2)
        abroad = F.concat(code, _digits(key, F.concat(F.lit("phone+"), code), F.substring(d, F.lit(3), n - 2)))
        done = F.when(n == 10, F.when(m.startswith("+"), abroad).otherwise(national(d)))
        done = done.when((n == 11) & d.startswith("1"), F.concat(F.lit("1"), national(F.substring(d, 2, 10)))).otherwise(abroad)
        return _fill(m, done)

    return _let(_only(m, "0-9"), swap)


def _date(key: Column, m: Column) -> Column:
    def put(day: Column) -> Column:
        first = F.make_date(F.floor(F.year(day) / 100).cast("int") * 100, F.lit(1), F.lit(1))
        long = F.floor(F.year(day) / 100) % 4 == 0
        low = F.when(long, 487).otherwise(397)
        n = F.datediff(day, first)
        new = _let(
            _feistel(key, F.concat(F.lit("date"), F.year(first).cast("string")), F.floor(n / low), n % low, F.when(long, 75).otherwise(92), low),
            lambda s: F.date_add(first, (s["a"] * low + s["b"]).cast("int")),
        )
        return _let(new, lambda x: _fill(m, F.when(m.rlike("^[0-9]{4}"), F.date_format(x, "yyyyMMdd")).when(m.contains("."), F.date_format(x, "ddMMyyyy")).otherwise(F.date_format(x, "MMddyyyy"))))

    def part(a: int, n: int) -> Column:
        return F.substring(m, a, n).cast("int")

    # Slashes are read month first, dots day first; what is no date so read stays as it is.
    zero = F.lit(0)
    day = F.when(m.rlike("^[0-9]{4}"), F.try_make_timestamp(part(1, 4), F.substring(m, 6, 2).cast("int"), F.substring(m, 9, 2).cast("int"), zero, zero, zero))
    day = day.when(m.contains("."), F.try_make_timestamp(part(7, 4), part(4, 2), part(1, 2), zero, zero, zero))
    day = day.otherwise(F.try_make_timestamp(part(7, 4), part(1, 2), part(4, 2), zero, zero, zero))
    return _let(day.cast("date"), lambda x: F.when(x.isNotNull() & (F.year(x) >= 100), put(x)).otherwise(m))


def _ip(key: Column, m: Column) -> Column:
    def swap(o: Column) -> Column:
        done = _let(
            _feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536)),
            lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")),
        )
        return F.when(F.forall(o, lambda x: x < 256) & ~m.rlike(r"(?:^|\.)0[0-9]"), done).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), swap)


def _ssn(key: Column, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    # Areas 1 to 899 but 666, groups from 1, serials from 1.
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def back(s: Column) -> Column:
        p = F.floor(s["a"] / 99)
        return F.concat_ws("-", _pad(F.when(p >= 665, p + 2).otherwise(p + 1), F.lit(3)), _pad(s["a"] % 99 + 1, F.lit(2)), _pad(s["b"] + 1, F.lit(4)))

    done = _let(_feistel(key, F.lit("ssn"), place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999)), back)
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), done).otherwise(m)


def _mod97(x: Column) -> Column:
    """Of letters and digits, letters as 10 to 35."""
    return F.aggregate(_chars(x), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _iban(key: Column, m: Column) -> Column:
    def swap(x: Column) -> Column:
        body, country = F.substring(x, F.lit(5), F.length(x) - 4), F.substring(x, 1, 2)
        d = _only(body, "0-9")
        new = _let(_fill(body, _digits(key, F.concat(F.lit("iban"), country, F.regexp_replace(body, "[0-9]", "0")), d)), lambda b: F.concat(_pad(98 - _mod97(F.concat(b, country, F.lit("00"))), F.lit(2)), b))
        # The letters stay where they are, so only digits are put back.
        return F.when((_mod97(F.concat(body, F.substring(x, 1, 4))) == 1) & F.length(d).between(2, 30), _fill(m, _only(new, "0-9"))).otherwise(m)

    return _let(_only(m, "A-Z0-9"), swap)


def _mail(key: Column, m: Column) -> Column:
    """The name before the @ is permuted, the host stays."""
    name = F.substring_index(m, "@", 1)
    host = F.substring(m, F.length(name) + 1, F.length(m))

    def shift(x: Column, stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(stream, (i * 4) % 64 + 1, F.lit(4)), 16, 10).cast("int") + i
            moved = lambda low, size: F.char(F.lit(low) + (F.ascii(c) - low + by) % size)
            return F.when(c.rlike("[a-z]"), moved(97, 26)).when(c.rlike("[A-Z]"), moved(65, 26)).when(c.rlike("[0-9]"), moved(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.filter(_chars(x), lambda c: c != ""), one), "")

    def rounds(n: Column) -> Column:
        u = F.floor(n / 2).cast("int")
        start = F.struct(F.substring(name, F.lit(1), u).alias("a"), F.substring(name, u + 1, n).alias("b"))

        def turn(s: Column, i: Column) -> Column:
            stream = lambda x: F.sha2(F.concat_ws(":", key, F.lit("mail"), n.cast("string"), i.cast("string"), x), 256)
            return F.when(i % 2 == 0, F.struct(shift(s["a"], stream(s["b"])).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), shift(s["b"], stream(s["a"])).alias("b")))

        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
        return _let(done, lambda s: F.concat(s["a"], s["b"], host))

    return _let(F.length(name), rounds)


def _kind(m: Column) -> Column:
    out = F.when(m.contains("@"), "email").when(m.rlike("^[A-Z]{2}"), "iban")
    for kind in ("date", "ip", "ssn", "card"):
        out = out.when(m.rlike("^(?:" + FORMS[kind].replace(r"(?<![0-9A-Za-z.])", "").replace(r"(?<![0-9A-Za-z-])", "") + ")$"), kind)
    return out.otherwise("phone")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col in pseudonyms, and a new last column pii: array<struct<kind, pseudonym>> of what was replaced,
    in the order of the text.

    Looked for: mail addresses, IBANs (right check digits), dates (real ones), IPv4 addresses (octets to 255), US social
    security numbers (assignable ones), card numbers (Luhn) and telephone numbers. What has the form but isn't valid stays.
    Null texts stay null, empty ones empty, both with an empty pii; all other columns, repeated rows and the whole rest of
    the text stay as they are. Very long texts are searched whole. Where two forms begin at one place, the first of FORMS
    counts. An empty table gives no rows. A column named pii, in any case of its letters, is replaced. The key is in no plan.
    """
    text = F.col(text_col)
    sorted_out = lambda m: F.struct(_kind(m).alias("kind"), m.alias("was"))
    names = shared.without(docs.columns, "pii")
    held, done, key_name = shared.fresh(names, "pii_found", "pii_done", "pii_key")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    # A subquery over a row of its own: plans, the UI and event logs show that there is a key, and not what it is.
    hidden = docs.sparkSession.sql("select * from values (:key) as t(key)", args={"key": key}).scalar()
    found = docs.select(*names, F.transform(hits, sorted_out).alias(held), hidden.alias(key_name))

    def replaced(h: Column) -> Column:
        by = {"email": _mail, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}
        out = F.lit(None).cast("string")
        for kind, f in by.items():
            out = F.when(h["kind"] == kind, f(F.col(key_name), h["was"])).otherwise(out)
        return F.struct(h["kind"].alias("kind"), h["was"].alias("was"), out.alias("pseudonym"))

    found = found.withColumn(done, F.when(F.size(held) > 0, F.transform(held, replaced)))
    pieces = F.split(text, PATTERN, -1)
    whole = F.array_join(F.zip_with(pieces, F.col(done), lambda p, h: F.concat(p, F.coalesce(h["pseudonym"], F.lit("")))), "")
    new = F.when(F.col(done).isNotNull(), whole).otherwise(text)
    pii = F.transform(F.filter(F.coalesce(done, F.array()), lambda h: h["was"] != h["pseudonym"]), lambda h: F.struct(h["kind"].alias("kind"), h["pseudonym"].alias("pseudonym")))
    return found.select(*(new.alias(c) if c.lower() == text_col.lower() else F.col(c) for c in names), pii.alias("pii"))


#: Of the query and the pipeline; a production run passes a secret of its own.
DEMO_KEY = "credsieve demo key"


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text and how many values of each kind were replaced."""
    done = pseudonymise(shared.table(spark, sf_dir, "documents"), DEMO_KEY)
    is_of = lambda kind: lambda h: h["kind"] == kind
    counts = [F.size(F.filter("pii", is_of(kind))).alias(f"n_{kind}") for kind in FORMS]
    return done.select("doc_id", "text", F.size("pii").alias("n_pii"), *counts)
