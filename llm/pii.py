"""Format-preserving pseudonyms by a keyed Feistel network, in built-in functions only.

Numbers and dates that pass the check of their kind are permuted within their format: a card number stays a valid
card number of its length, a date stays a date, separators stay where they are. The permutation depends on the key
and the kind alone, so one value gets one pseudonym in all documents, and two values never share one.

The network works on pairs (l, r) of whole numbers below a and b whose product is the size of the domain, and
alternates l += F(r) mod a and r += F(l) mod b. That is a bijection of the domain itself: no value is walked again.

Kinds: card (13 to 19 digits, Luhn), iban (mod 97), ssn (areas and groups in use), phone (country code or three-three-four
digits), ipv4 (octets to 255), date (real days of 1800 to 2199), email (letters and digits of the local part; the domain
stays). What fails its check stays as it is.

Defined results: a null text stays null with zero counts; empty and long texts are treated whole; repeated rows each give
a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import plain

ROUNDS = 8
KINDS = ("email", "iban", "ipv4", "date", "ssn", "phone", "card")

# Fixed patterns of the kinds.
EMAIL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
YEAR_FIRST = r"(?<![0-9./-])[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}(?![0-9])"
YEAR_LAST = r"(?<![0-9./-])[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2,3}(?: [0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){2,3}(?:-[0-9]{1,3})?)(?![0-9])"
ANY = "|".join((EMAIL, IBAN, IPV4, YEAR_FIRST, YEAR_LAST, SSN, PHONE, CARD))
#: First and last day of the dates that are permuted: 400 years, 146,097 days = 189 * 773.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def feistel(l: Column, r: Column, a: Column, b: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:  # noqa: E741
    """Permute the pair (l, r) of the domain a x b; returns a struct (l, r)."""

    def mixed(number: Column, half: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), half.cast("string"), a.cast("string"), b.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def turn(pair: Column, number: Column) -> Column:
        even = number % 2 == 0
        return F.struct(
            F.when(even, (pair["l"] + mixed(number, pair["r"]) % a) % a).otherwise(pair["l"]).alias("l"),
            F.when(even, pair["r"]).otherwise((pair["r"] + mixed(number, pair["l"]) % b) % b).alias("r"),
        )

    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    return F.aggregate(F.lit(list(range(rounds))), start, turn)


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once: a fold over one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string to one of the same length, to 34 digits."""
    n = F.length(digits)
    left = (n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    half = lambda s: F.coalesce(s.cast("long"), F.lit(0))
    pair = feistel(half(digits.substr(F.lit(1), left)), half(digits.substr(left + 1, n - left)), power(left), power(n - left), key, kind)
    shown = lambda x, k: F.when(k > 0, F.lpad(x.cast("string"), k, "0")).otherwise("")
    return bind(pair, lambda p: F.concat(shown(p["l"], left), shown(p["r"], n - left)))


def put_back(value: Column, digits: Column, at: str = "[0-9]") -> Column:
    """value with its characters of a class replaced, in order, by those of digits."""

    def step(state: Column, c: Column) -> Column:
        hit = c.rlike(at)
        return F.struct(
            F.concat(state["s"], F.when(hit, digits.substr(state["i"], F.lit(1))).otherwise(c)).alias("s"),
            (state["i"] + hit.cast("int")).alias("i"),
        )

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step, lambda state: state["s"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose last digit is its check digit."""

    def worth(d: Column, i: Column) -> Column:
        x = d.cast("int")
        return F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    figures = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.aggregate(F.transform(figures, worth), F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """Remainder of an IBAN's characters read as digits, letters as 10 to 35."""

    def step(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        worth = F.when(letter, F.ascii(c) - 55).otherwise(c.cast("int"))
        return (rest * F.when(letter, 100).otherwise(10) + worth) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def card(value: Column, key: str) -> Column:
    digits = digits_of(value)

    def new(d: Column) -> Column:
        body = permuted_digits(d.substr(F.lit(1), F.length(d) - 1), key, "card")
        return bind(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    fits = F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0) & (digits != F.repeat(F.lit("0"), F.length(digits)))
    return F.when(fits, bind(bind(digits, new), lambda d: put_back(value, d)))


def iban(value: Column, key: str) -> Column:
    flat = F.regexp_replace(value, " ", "")
    body = lambda v: v.substr(F.lit(5), F.length(v) - 4)

    def new(v: Column) -> Column:
        figures = digits_of(body(v))
        moved = bind(permuted_digits(figures, key, "iban"), lambda d: put_back(body(v), d))
        check = lambda b: F.lpad((98 - mod97(F.concat(b, v.substr(1, 2), F.lit("00")))).cast("string"), 2, "0")
        return bind(moved, lambda b: F.concat(v.substr(1, 2), check(b), b))

    fits = F.length(flat).between(15, 34) & (mod97(F.concat(body(flat), flat.substr(1, 4))) == 1) & (F.length(digits_of(body(flat))) > 0)
    return F.when(fits, bind(bind(flat, new), lambda v: put_back(value, v, "[A-Z0-9]")))


def ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999: 88,902 * 9,999 numbers."""
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    fits = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    at = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1
    pair = feistel(at, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def shown(p: Column) -> Column:
        n = F.floor(p["l"] / 99)
        return F.format_string("%03d-%02d-%04d", F.when(n >= 665, n + 2).otherwise(n + 1), p["l"] % 99 + 1, p["r"] + 1)

    return F.when(fits, bind(pair, shown))


def phone(value: Column, key: str) -> Column:
    """The country code stays; the digits after it are permuted."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = value.substr(F.length(code) + 1, F.length(value))
    figures = digits_of(rest)
    fits = F.length(digits_of(value)).between(8, 15)
    return F.when(fits, F.concat(code, bind(permuted_digits(figures, key, "phone"), lambda d: put_back(rest, d))))


def ipv4(value: Column, key: str) -> Column:
    octet = [F.split_part(value, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    pair = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, "ipv4")
    high = lambda x: F.floor(x / 256)
    shown = lambda p: F.concat_ws(".", high(p["l"]), p["l"] % 256, high(p["r"]), p["r"] % 256)
    return F.when(F.greatest(*octet) < 256, bind(pair, shown))


def date(value: Column, key: str) -> Column:
    """Year first, or year last: then slash and hyphen mean month first where that gives a day, a full stop day first."""
    mark = F.regexp_extract(value, "[./-]", 0)
    one, two, three = (F.split(value, "[./-]").getItem(i) for i in range(3))
    first = one.rlike("^[0-9]{4}$")
    us = ~first & (mark != ".") & (one.cast("int") <= 12)
    y, m, d = F.when(first, one).otherwise(three), F.when(us, one).otherwise(two), F.when(us, two).otherwise(F.when(first, three).otherwise(one))
    day = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    pair = feistel((n / DAYS_B).cast("int"), n % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), key, "date")

    def shown(p: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS_B + p["r"]).cast("int"))
        part = lambda form, old: F.when(F.length(old) == 1, F.regexp_replace(F.date_format(new, form), "^0", "")).otherwise(F.date_format(new, form))
        year, month, days = F.date_format(new, "yyyy"), part("MM", m), part("dd", d)
        joined = lambda *x: F.concat(x[0], mark, x[1], mark, x[2])
        return F.when(first, joined(year, month, days)).when(us, joined(month, days, year)).otherwise(joined(days, month, year))

    return F.when(day.isNotNull() & n.between(0, DAYS_A * DAYS_B - 1), bind(pair, shown))


def permuted_symbols(symbols: Column, alphabet: str, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A string over an alphabet to one of the same length: a Feistel network whose halves are strings, each symbol of
    one half moved along the alphabet by a keyed hash of the other half and its place."""
    letters, size = F.lit(alphabet), len(alphabet)
    cut = (F.length(symbols) / 2).cast("int")

    def moved(half: Column, other: Column, number: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            text = F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), i.cast("string"), F.length(half).cast("string"), other)
            shift = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
            return letters.substr(((F.instr(letters, c) - 1 + shift) % size + 1).cast("int"), F.lit(1))

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def turn(pair: Column, number: Column) -> Column:
        even = number % 2 == 0
        return F.struct(
            F.when(even, moved(pair["l"], pair["r"], number)).otherwise(pair["l"]).alias("l"),
            F.when(even, pair["r"]).otherwise(moved(pair["r"], pair["l"], number)).alias("r"),
        )

    start = F.struct(symbols.substr(F.lit(1), cut).alias("l"), symbols.substr(cut + 1, F.length(symbols)).alias("r"))
    return F.aggregate(F.lit(list(range(rounds))), start, turn, lambda pair: F.concat(pair["l"], pair["r"]))


def email(value: Column, key: str) -> Column:
    """Letters and digits of the local part; letter case counts for nothing and comes out lower."""
    local, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.regexp_extract(value, "@.*", 0)
    low = F.lower(local)
    figures = permuted_symbols(digits_of(low), "0123456789", key, "email")
    words = permuted_symbols(F.regexp_replace(low, "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", key, "email")
    named = bind(words, lambda w: put_back(low, w, "[a-z]"))
    return F.when(low.rlike("[a-z0-9]"), F.concat(bind(figures, lambda d: bind(named, lambda v: put_back(v, d))), domain))


def pseudonym(value: Column, key: str) -> Column:
    """A struct (kind, text) for what passes the check of its kind; kind is null for the rest."""
    rules = (
        (EMAIL, "email", email), (IPV4, "ipv4", ipv4), (YEAR_FIRST + "|" + YEAR_LAST, "date", date), (SSN, "ssn", ssn),
        (PHONE, "phone", phone), (CARD, "card", card), (IBAN, "iban", iban),
    )

    def tried(rest: Column, rule: tuple) -> Column:
        pattern, kind, make = rule
        done = lambda new: F.struct(F.when(new.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(new, value).alias("text"))
        return F.when(value.rlike(whole(pattern)), bind(make(value, key), done)).otherwise(rest)

    nothing = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"))
    return reduce(tried, reversed(rules), nothing)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text with pseudonyms, n_<kind> values replaced, changed.

    The text is split at the matches and joined again with the pseudonyms between the pieces: one pass over the rows,
    no shuffle. Texts without a digit or an at sign are not split.
    """
    text = F.col("text")
    rows = docs.select(plain(id_col).alias("id"), plain(text_col).cast("string").alias("text"))
    bare = F.array().cast("array<struct<kind:string,text:string>>")
    found = F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: pseudonym(v, key))).otherwise(bare)
    rows = rows.withColumn("found", found)
    pieces = F.zip_with(F.split("text", ANY, -1), "found", lambda gap, new: F.concat(gap, F.coalesce(new["text"], F.lit(""))))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    kinds = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    changed = F.coalesce(F.exists("found", lambda x: x["kind"].isNotNull()), F.lit(False))
    return rows.select(F.col("id").alias(id_col), F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(text).alias("text"), *kinds, changed.alias("changed"))
