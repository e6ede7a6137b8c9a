"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated values are replaced by others of the same format, by a permutation that a key fixes: equal values get equal
pseudonyms in all documents, different ones different pseudonyms, and whoever has the key can go back.
- Card numbers (13 to 19 digits whose Luhn check holds, in any groups; next to other numbers, in groups of 4 or more but for
  the last): all digits but the last are permuted, the last is their check digit.
- Phone numbers (+country code and 8 to 15 digits in all, or 3-3-4 digits with brackets, hyphens or dots): the digits after
  the country code are permuted in place; those of social security numbers (3-2-4 digits) all are.
- IPv4 addresses (parts up to 255): permuted among the 2^32 addresses.
- Dates (ISO, also before a time, or day/month/year, valid, from 1900-01-01 to 2099-08-03): permuted among those 72,900 days.
  Month/day/year is read where day/month/year is no date, and permuted among the days that can be written so.
Values without a numeric format get a keyed digest of the same form: e-mail addresses (name and domain replaced) and
secrets of 32 or more hex digits (same length).

A Feistel network with halves of u and v digits adds a keyed round function of one half to the other, modulo its size,
for ROUNDS rounds; a fold over the round numbers keeps the expression small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import read_table

ROUNDS = 10
#: Setting that names the key; the default is for tests and public data only.
KEY_CONF, DEFAULT_KEY = "spark.filmloom.pii.key", "not-a-secret"
FIRST_DAY, SIDE, WALK = "1900-01-01", 270, 64

#: Bytes of a run's output that are set aside together: a longer string would be copied at each of its groups.
PIECE = 4096

# Groups repeated without a bound are possessive: Java's other ones call themselves once per repeat, and a long run ends the
# executor with a StackOverflowError. A domain ends in the letters of its last label that begins with two.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[A-Za-z0-9-]*+(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2,}+)++"
SECRET = r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])"
_EIGHT_TO_15 = r"[ .()-]{0,2}\d" * 8 + r"(?:[ .()-]{0,2}\d)?" * 7
# With a country code in groups of 3-3-4 or others, then national.
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|(?<![\w+])\+\d{{1,3}}(?:[ .-]?\(?\d{{1,4}}\)?){{2,5}}(?<=\+{_EIGHT_TO_15}\)?)(?!\d|[./-]\d)"
    r"|(?<![\w+.(-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)"
)
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE = r"(?<![\w/-])(?:\d{4}-\d{1,2}-\d{1,2}(?=T\d|(?![\w/-]))|\d{1,2}/\d{1,2}/\d{4}(?![\w/-]))"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
# A run of 13 or more digits with one kind of separator, which may hold cards and other numbers, or a card with two kinds.
# The run ends before a last group that doesn't end well; the group that holds its 13th digit must.
_run = lambda sep, end: rf"\d(?=(?:{sep}?\d){{12}}\d*+{end})\d*+(?:{sep}\d++{end})*+"
CARD = rf"(?<![\w])(?:{_run(' ', r'(?![\w]|[./-]\d)')}|{_run('-', r'(?![\w/]|\.\d)')}|\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]?\d{{1,7}}(?![\w]))"
KINDS = (("email", EMAIL), ("secret", SECRET), ("phone", PHONE), ("ssn", SSN), ("date", DATE), ("ip", IP), ("card", CARD))
ANY = "|".join(p for _, p in KINDS)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prf(key: Column, *parts: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(key: Column, kind: Column, a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """A permutation of pairs (a, b), a below n_a and b below n_b, as a struct of the two."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        x = F.when(even, F.pmod(acc["a"] + prf(key, kind, i, acc["b"]), n_a.cast("long"))).otherwise(acc["a"])
        y = F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + prf(key, kind, i, acc["a"]), n_b.cast("long")))
        return F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def permute_digits(key: Column, digits: Column, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""

    def body(z: Column) -> Column:
        n = F.length(z)
        u = (n / 2).cast("int")
        a, b = F.substr(z, F.lit(1), u).cast("long"), F.substr(z, u + 1, n - u).cast("long")
        size = lambda k: F.pow(F.lit(10.0), k).cast("long")
        out = feistel(key, F.concat(F.lit(kind), n.cast("string")), a, b, size(u), size(n - u))
        return _bind(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, F.lit("0")), F.lpad(s["b"].cast("string"), n - u, F.lit("0"))))

    return _bind(digits, body)


def luhn_sum(digits: Column, even_first: bool) -> Column:
    """Sum of the digits from the right, every second one doubled; even_first: the rightmost is doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _bind(F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == (0 if even_first else 1), 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + d)


def refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, one by one, by the given ones."""
    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(acc["o"], F.when(digit, F.substr(digits, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("o"), (acc["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["o"])


def cards(x: Column, key: Column) -> Column:
    """A struct (o, n): x, a match of CARD, with its card numbers replaced, the first and longest ones first, and how many."""
    groups = F.split(x, "(?<=[ -])")

    def body(g: Column) -> Column:
        def part(i: Column, j: Column) -> Column:
            return F.concat_ws("", F.slice(g, i + 1, j - i))

        def is_card(i: Column, j: Column) -> Column:
            digits = _digits(part(i, j))
            usual = (i == 0) & (j == F.size(g)) | F.forall(F.slice(g, i + 1, j - i - 1), lambda c: F.length(_digits(c)) >= 4)
            return F.length(digits).between(13, 19) & usual & (luhn_sum(digits, False) % 10 == 0)

        def put(form: Column) -> Column:
            digits = _digits(form)
            out = permute_digits(key, F.substr(digits, F.lit(1), F.length(digits) - 1), "card")
            return _bind(out, lambda b: refill(form, F.concat(b, ((10 - luhn_sum(b, True) % 10) % 10).cast("string"))))

        def step(acc: Column, i: Column) -> Column:
            full = F.octet_length(acc["o"]) > PIECE
            done, o = F.when(full, F.concat(acc["done"], F.array(acc["o"]))).otherwise(acc["done"]), F.when(full, F.lit("")).otherwise(acc["o"])
            # Six groups, five of them of 4 digits or more, have too many digits.
            last = F.when((i == 0) & (F.size(g) <= 19), F.size(g)).otherwise(F.least(i + 5, F.size(g)))
            ends = F.filter(F.sequence(last, i + 1), lambda j: is_card(i, j))

            def go(e: Column) -> Column:
                end = F.get(e, F.lit(0))
                found = F.struct(done.alias("done"), F.concat(o, _bind(part(i, end), put)).alias("o"), (acc["n"] + 1).alias("n"), end.alias("at"))
                return F.when(end.isNotNull(), found).otherwise(F.struct(done.alias("done"), F.concat(o, F.get(g, i)).alias("o"), acc["n"].alias("n"), (i + 1).alias("at")))

            return F.when(i < acc["at"], acc).otherwise(_bind(ends, go))

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("o"), F.lit(0).alias("n"), F.lit(0).alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step, lambda acc: F.struct(F.concat(F.concat_ws("", acc["done"]), acc["o"]).alias("o"), acc["n"].alias("n")))

    return _bind(groups, body)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def pseudonym(x: Column, key: Column) -> Column:
    """A struct (kind, value, n) for a match of ANY: the kind that holds after validation, or null, its pseudonym, or x itself, and how many."""
    is_ = lambda p: F.regexp_like(x, F.lit(f"^(?:{p})$"))
    digits = _digits(x)
    digest = lambda kind, v, n: F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), v), 512), 1, n)
    email = F.concat(digest("email", x, 12), F.lit("@"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("domain"), F.substring_index(x, "@", -1)), 256), 1, 8), F.lit(".invalid"))
    secret = F.substr(F.repeat(digest("secret", F.lower(x), 128), F.lit(4)), F.lit(1), F.length(x))
    secret = F.when(F.regexp_like(x, F.lit("[A-F]")) & ~F.regexp_like(x, F.lit("[a-f]")), F.upper(secret)).otherwise(secret)
    n = F.length(digits)
    country = F.when(F.startswith(x, F.lit("+")), F.length(F.regexp_extract(digits, COUNTRY, 1))).otherwise(0)
    keep = F.when(n <= 13, F.greatest(country, n - 10)).otherwise(country)
    phone = _bind(keep, lambda k: refill(x, F.concat(F.substr(digits, F.lit(1), k), permute_digits(key, F.substr(digits, k + 1, n - k), "phone"))))
    ssn = refill(x, permute_digits(key, digits, "ssn"))
    octets = F.split(x, r"\.")
    octet = lambda i: F.get(octets, i).try_cast("int")
    ip_ok = is_(IP) & (F.greatest(*[octet(i) for i in range(4)]) <= 255)
    word = F.lit(65536)
    ip = _bind(feistel(key, F.lit("ip"), octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), word, word), lambda s: F.concat_ws(".", *[v.cast("int").cast("string") for v in (s["a"] / 256, s["a"] % 256, s["b"] / 256, s["b"] % 256)]))
    iso = F.substring(x, 5, 1) == "-"
    plain = F.when(iso, F.try_to_date(x, "yyyy-M-d")).otherwise(F.try_to_date(x, "d/M/yyyy"))
    month_first = plain.isNull()
    day = F.datediff(F.coalesce(plain, F.try_to_date(x, "M/d/yyyy")), F.lit(FIRST_DAY).cast("date"))
    date_ok = is_(DATE) & day.between(0, SIDE * SIDE - 1)
    as_date = lambda d: F.date_add(F.lit(FIRST_DAY).cast("date"), d.cast("int"))
    turn = lambda d: _bind(feistel(key, F.lit("date"), (d / SIDE).cast("int"), d % SIDE, F.lit(SIDE), F.lit(SIDE)), lambda s: (s["a"] * SIDE + s["b"]).cast("int"))
    # The first day past the 12th along the permutation: two days of three are, so WALK steps suffice.
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), turn(day), lambda d, i: F.when(F.dayofmonth(as_date(d)) > 12, d).otherwise(turn(d)))
    moved = F.when(month_first, walk).otherwise(turn(day))
    short = F.regexp_like(x, F.lit(r"\b\d\b"))
    written = lambda d, long, brief: F.when(short, F.date_format(d, brief)).otherwise(F.date_format(d, long))
    date = _bind(as_date(moved), lambda d: F.when(iso, written(d, "yyyy-MM-dd", "yyyy-M-d")).when(month_first, written(d, "MM/dd/yyyy", "M/d/yyyy")).otherwise(written(d, "dd/MM/yyyy", "d/M/yyyy")))
    pick = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(1).alias("n"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value"), F.lit(0).alias("n"))
    card = _bind(cards(x, key), lambda c: F.when(c["n"] > 0, F.struct(F.lit("card").alias("kind"), c["o"].alias("value"), c["n"].alias("n"))).otherwise(none))
    return (
        F.when(is_(EMAIL), pick("email", email)).when(is_(SECRET), pick("secret", secret)).when(is_(PHONE), pick("phone", phone)).when(is_(SSN), pick("ssn", ssn))
        .when(date_ok, pick("date", date)).when(ip_ok, pick("ip", ip)).when(is_(CARD), card).otherwise(none)
    )


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """id_col, text with pseudonyms, n_found, and found: the kinds replaced, in order.

    A null text stays null with nothing found; an empty one stays empty. What looks like a value but fails its check
    (a card's Luhn sum, an address part over 255, an impossible or far date) is left as it is. Repeated rows are treated
    alike; an empty table gives an empty result; other columns don't matter.
    """
    secret = F.lit(key if key is not None else docs.sparkSession.conf.get(KEY_CONF, DEFAULT_KEY))
    text = F.col("_t")
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    # Every kind has a digit or an @: most texts are done after one look.
    df = df.withColumn("_hits", F.when(F.regexp_like(text, F.lit("[0-9@]")), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_new", F.transform("_hits", lambda x: pseudonym(x, secret)))
    gaps = F.split(text, ANY, -1)
    glued = F.concat_ws("", F.flatten(F.zip_with(gaps, F.col("_new"), lambda g, n: F.array(g, n["value"]))))
    out = F.when(F.size("_hits") > 0, glued).otherwise(text)
    kinds = F.flatten(F.transform("_new", lambda n: F.array_repeat(n["kind"], n["n"])))
    return df.select(F.col("_id").alias(id_col), out.alias("text"), F.size(kinds).cast("long").alias("n_found"), kinds.alias("found"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"))
