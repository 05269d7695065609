"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Each kind of value is checked first: card and account numbers by their check digits, dates
by the calendar, addresses by their ranges. A valid value goes through a keyed Feistel
network over its own domain and is written back in the format it came in, check digits
renewed. The network is a permutation, so equal values have equal pseudonyms in every
document and different values different ones.

The key is a parameter of the plan: keep plans and event logs as safe as the key itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# What each kind looks like (Java patterns).
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(+.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?:(?<![\w.-])|(?<=\d-))\d(?:[ -]?\d){12,18}(?!\w|-(?!\d))",
}
#: First the kinds with most structure; a place is of the first kind that fits and is valid.
#: Texts are cut wherever a kind may begin, inside longer matches too.
START = f"(?={'|'.join(PATTERNS.values())})"
#: Characters that an e-mail address or anything else may take, and the places inside at
#: which other kinds may begin.
LONGEST_EMAIL, LONGEST, STARTS = 640, 64, 64
#: Kinds whose groups may run on into neighbours: shorter readings are tried too.
RUN_ON = ("phone", "iban", "card")
#: Country codes with the digits that follow, where the plan of the country fixes them.
#: Elsewhere any 8 to 15 digits are a number.
PHONE_LENGTHS = (
    "1[0-9]{10}|7[0-9]{10}|20[0-9]{8,10}|(?:27|3[0134]|4[0178]|56|6[1]|9[34])[0-9]{9}|3[26][0-9]{8,9}|44[0-9]{10}"
    "|(?:45|65)[0-9]{8}|46[0-9]{7,9}|(?:52|58|9[018])[0-9]{10}|51[0-9]{8,9}|5[45][0-9]{10,11}|6[346][0-9]{8,10}"
    "|8[124][0-9]{9,10}|86[0-9]{10,11}|92[0-9]{9,10}|351[0-9]{9}|353[0-9]{7,9}|354[0-9]{7}|355[0-9]{8,9}"
    "|(?:356|357|370|371|373|374|852|853|965|968|973|974)[0-9]{8}|359[0-9]{7,9}|372[0-9]{7,8}|(?:375|380|420|421|966)[0-9]{9}"
    "|(?:381|385|386|886|962|971|972)[0-9]{8,9}|880[0-9]{10}"
)

#: Country codes: none begins another, so digits alone tell where a code ends.
PHONE_CODE = "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"

#: Days of one Gregorian cycle, 189 x 773, from this day on: a date of theirs stays among them.
FIRST_DAY, CYCLE = "1800-01-01", (189, 773)
#: All other days of the years 1 to 9999, 762 x 4,601, among which the others stay.
YEAR_ONE, OTHERS = "0001-01-01", (762, 4_601)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the expression a single time, however often it is used."""
    return F.transform(F.array(value), use)[0]


def number_from(hexadecimal: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("bigint")


def mac(key: str, tweak: Column, value: Column) -> Column:
    """Hexadecimal keyed hash, the key on both sides of what is hashed."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, value, F.lit(key)), 256)


def feistel(left: Column, right: Column, left_size: Column | int, right_size: Column | int, key: str, tweak: str | Column) -> Column:
    """Struct (left, right) permuted over [0, left_size) x [0, right_size)."""
    sizes = [s.cast("bigint") if isinstance(s, Column) else F.lit(s).cast("bigint") for s in (left_size, right_size)]
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def turn(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, state["right"]).otherwise(state["left"])
        add = number_from(mac(key, F.concat_ws(".", tweak, i.cast("string")), other.cast("string")))
        return F.struct(
            F.when(even, F.pmod(state["left"] + add, sizes[0])).otherwise(state["left"]).alias("left"),
            F.when(even, state["right"]).otherwise(F.pmod(state["right"] + add, sizes[1])).alias("right"),
        )

    start = F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A digit string of up to 36 digits permuted among strings of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = [F.pow(F.lit(10.0), w).cast("bigint") for w in (half, n - half)]
    parts = (F.coalesce(F.substring(digits, F.lit(1), half).try_cast("bigint"), F.lit(0)), F.substring(digits, half + 1, n - half).cast("bigint"))
    network = feistel(*parts, *size, key, F.concat(F.lit(tweak), n.cast("string")))
    # An array of one, so that the network is evaluated once for both halves.
    return F.transform(
        F.array(network),
        lambda p: F.concat(
            F.when(half > 0, F.lpad(p["left"].cast("string"), half, F.lit("0"))).otherwise(F.lit("")),
            F.lpad(p["right"].cast("string"), n - half, F.lit("0")),
        ),
    )[0]


def refill(format_: Column, digits: Column) -> Column:
    """The format with its digits replaced, one by one, by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    filled = F.aggregate(
        F.split(format_, ""),
        start,
        lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substring(digits, s["used"] + 1, F.lit(1))).alias("out"), (s["used"] + 1).alias("used")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["used"].alias("used"))),
    )
    return filled["out"]


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Digits summed from the right, every second doubled and cast out nines."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def card_pseudonym(value: Column, key: str) -> Column:
    """First digit kept, check digit renewed."""
    digits = only_digits(value)
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permuted_digits(F.substring(digits, F.lit(2), n - 2), key, "card"))
    with_check = F.transform(
        F.array(body), lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    )[0]
    return refill(value, with_check)


def valid_card(value: Column) -> Column:
    digits = only_digits(value)
    return (luhn_sum(digits) % 10 == 0) & ~digits.rlike(r"^(\d)\1*$")


def iban_remainder(country_last: Column) -> Column:
    """Remainder by 97 of digits and letters (A: 10 ... Z: 35) read as one number."""

    def add(r: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike(r"^\d$"), (r * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((r * 100 + letter) % 97)

    return F.aggregate(F.split(country_last, ""), F.lit(0), add)


def valid_iban(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (iban_remainder(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1)


def iban_pseudonym(value: Column, key: str) -> Column:
    """Country and letters kept, digits of the account permuted, check digits renewed."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), F.substring(plain, 5, 40)
    changed = F.when(F.length(only_digits(account)) > 0, refill(account, permuted_digits(only_digits(account), key, "iban"))).otherwise(account)
    whole = F.transform(
        F.array(changed),
        lambda a: F.concat(F.lpad((98 - iban_remainder(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), only_digits(a)),
    )[0]
    return refill(value, whole)


def ip_pseudonym(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.")
    n = [octets[i].cast("bigint") for i in range(4)]
    network = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ip")
    return F.transform(
        F.array(network),
        lambda p: F.concat_ws(".", *(x.cast("string") for side in ("left", "right") for x in (F.floor(p[side] / 256), p[side] % 256))),
    )[0]


def ssn_valid(value: Column) -> Column:
    return ~value.rlike(r"^(000|666|9)|-00-|-0000$")


def ssn_pseudonym(value: Column, key: str) -> Column:
    """Among the 898 x 99 x 9,999 numbers that may be issued."""
    parts = F.split(value, "-")
    area, group, serial = (parts[i].cast("bigint") for i in range(3))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    network = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def write(p: Column) -> Column:
        at = F.floor(p["left"] / 99)
        area = at + 1 + F.when(at >= 665, 1).otherwise(0)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), w, "0") for x, w in ((area, 3), (p["left"] % 99 + 1, 2), (p["right"] + 1, 4))))

    return F.transform(F.array(network), write)[0]


def date_parts(value: Column) -> tuple[Column, Column, Column]:
    """Year, month, day as text. Year first or last; with a slash or dash and the year last
    the month comes first if that gives a date, otherwise the day."""
    parts = F.split(value, r"[./-]")
    year_first = F.length(parts[0]) == 4
    day_first = value.contains(".") | (parts[0].cast("int") > 12)
    year = F.when(year_first, parts[0]).otherwise(parts[2])
    month = F.when(year_first | day_first, parts[1]).otherwise(parts[0])
    day = F.when(year_first, parts[2]).otherwise(F.when(day_first, parts[0]).otherwise(parts[1]))
    return year, month, day


def day_number(value: Column) -> Column:
    """Days from FIRST_DAY, negative before it; null for what is no date of the years 1 to 9999."""
    day = F.concat_ws("-", *(F.lpad(p, w, "0") for p, w in zip(date_parts(value), (4, 2, 2), strict=True))).try_cast("date")
    return F.when(day >= F.lit(YEAR_ONE).cast("date"), F.date_diff(day, F.lit(FIRST_DAY).cast("date")))


def date_pseudonym(value: Column, key: str) -> Column:
    """Another day in the same order and with the same separators; two digits for day and
    month, four for the year. Days of the cycle are permuted among themselves, and so are all
    days outside it."""
    first = F.lit(FIRST_DAY).cast("date")
    before = F.date_diff(first, F.lit(YEAR_ONE).cast("date"))
    days = CYCLE[0] * CYCLE[1]
    parts = F.split(value, r"[./-]")
    separator = F.regexp_extract(value, r"[./-]", 0)

    def write(day: Column) -> Column:
        y, m, d = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
        # The day stays first where it was seen to be: a month of over 12 does not occur.
        day_first = value.contains(".") | (parts[0].cast("int") > 12)
        return (
            F.when(F.length(parts[0]) == 4, F.concat_ws("-", y, m, d))
            .when(day_first, F.concat_ws("-", d, m, y))
            .otherwise(F.concat_ws("-", m, d, y))
        )

    def moved(n: Column) -> Column:
        inside = (n >= 0) & (n < days)
        left, right = (F.when(inside, a).otherwise(b) for a, b in zip(CYCLE, OTHERS, strict=True))
        place = F.when(inside, n).otherwise(F.when(n < 0, n + before).otherwise(n + before - days))
        network = feistel(F.floor(place / right), place % right, left, right, key, F.when(inside, "date").otherwise("date.others"))
        at = once(network, lambda p: p["left"] * right + p["right"])
        return once(at, lambda x: F.date_add(first, F.when(inside, x).otherwise(x - before + F.when(x < before, 0).otherwise(days)).cast("int")))

    return F.replace(once(once(day_number(value), moved), write), F.lit("-"), separator)


def phone_pseudonym(value: Column, key: str) -> Column:
    """Digits after the country code permuted: the same for a number in every format.

    The code is told by its digits, whatever separators follow. A number without a code has
    its digits permuted as they are after one.
    """
    def code(known: Column) -> Column:
        written = F.concat(F.lit("+"), known)
        return F.when((known != "") & value.startswith(written), written).otherwise(F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0))

    def national(rest: Column) -> Column:
        return refill(rest, permuted_digits(only_digits(rest), key, "phone"))

    found = once(F.regexp_extract(only_digits(value), PHONE_CODE, 0), code)
    return once(found, lambda c: F.concat(c, once(F.substring(value, F.length(c) + 1, F.length(value)), national)))


def valid_phone(value: Column) -> Column:
    return F.length(only_digits(value)).between(8, 15)


def shifted_characters(part: Column, stream: Column) -> Column:
    """Each letter or digit moved in its own class by a pair of the keyed stream's digits."""

    def shift(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, 1 + (4 * i) % 60, F.lit(4)), 16, 10).cast("int")
        moved = [
            F.when(c.rlike(f"^[{chr(first)}-{chr(first + size - 1)}]$"), F.char(first + F.pmod(F.ascii(c) - first + by, F.lit(size))))
            for first, size in ((48, 10), (97, 26), (65, 26))
        ]
        return F.coalesce(*moved, c)

    return F.transform(part, shift)


def email_pseudonym(value: Column, key: str) -> Column:
    """Letters and digits of the local part permuted by a network over characters; the
    domain stays. Case is kept and does not tell addresses apart."""
    local = F.substring_index(value, "@", 1)
    letters = F.split(local, "")
    half = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.slice(letters, F.lit(1), half).alias("left"), F.slice(letters, half + 1, F.length(local) - half).alias("right"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.lower(F.array_join(F.when(even, s["right"]).otherwise(s["left"]), ""))
        stream = mac(key, F.concat(F.lit("email."), i.cast("string")), other)
        return F.struct(
            F.when(even, shifted_characters(s["left"], stream)).otherwise(s["left"]).alias("left"),
            F.when(even, s["right"]).otherwise(shifted_characters(s["right"], stream)).alias("right"),
        )

    network = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    joined = F.transform(F.array(network), lambda s: F.array_join(F.concat(s["left"], s["right"]), ""))[0]
    return F.concat(joined, F.substring(value, F.length(local) + 1, F.length(value)))


def known_phone(value: Column) -> Column:
    """As many digits as the country has; ten where none is named."""
    digits = only_digits(value)
    return F.when(value.startswith("+"), digits.rlike(f"^(?:{PHONE_LENGTHS})$")).otherwise(F.length(digits) == 10)


VALID = {
    "email": [lambda value: F.lit(True)],
    "ip": [lambda value: F.lit(True)],
    "date": [lambda value: day_number(value).isNotNull()],
    "ssn": [ssn_valid],
    # The first rule that some reading meets decides.
    "phone": [known_phone, valid_phone],
    "iban": [valid_iban],
    "card": [valid_card],
}
PSEUDONYMS = {
    "email": email_pseudonym,
    "ip": ip_pseudonym,
    "date": date_pseudonym,
    "ssn": ssn_pseudonym,
    "phone": phone_pseudonym,
    "iban": iban_pseudonym,
    "card": card_pseudonym,
}


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def reading(kind: str, window: Column) -> Column:
    """The longest valid value of the kind at the third character of the window; null if none.

    Kinds that run on may end at any group border of the match.
    """
    pattern = PATTERNS[kind]

    def chosen(match: Column) -> Column:
        if kind not in RUN_ON:
            return F.when((match != "") & VALID[kind][0](match), match)

        def at_border(n: Column) -> Column:
            return (n == F.length(match)) | F.substring(match, n + 1, F.lit(1)).rlike(r"[ .(-]")

        lengths = F.filter(F.sequence(F.length(match), F.lit(1), F.lit(-1)), at_border)
        shorter = F.filter(F.transform(lengths, lambda n: F.substring(match, F.lit(1), n)), lambda v: v.rlike(whole(pattern)))
        first = F.transform(F.array(shorter), lambda vs: F.coalesce(*(F.get(F.filter(vs, valid), F.lit(0)) for valid in VALID[kind])))
        return F.when(match != "", first[0])

    most = LONGEST_EMAIL if kind == "email" else LONGEST
    match = F.regexp_extract(F.substring(window, 1, most), rf"(?s)\A..({pattern})", 1)
    return F.transform(F.array(match), chosen)[0]


def read_at(parts: Column, i: Column) -> Column:
    """Struct (kind, value, n, own, over) of the part that begins a text's i-th cut: what is
    read there (kind is null if nothing), its length, the part's own length and the number
    of parts that the value touches."""
    before = F.substring(F.coalesce(F.get(parts, i - 1), F.lit("")), -2, 2)
    before = F.lpad(F.regexp_replace(before, r"[^\w.%+(/-]", " "), 2, " ")
    near = F.slice(parts, i + 1, F.lit(STARTS))
    enough = lambda text, part: F.when(F.length(text) >= LONGEST_EMAIL, text).otherwise(F.concat(text, F.substring(part, 1, LONGEST_EMAIL)))
    window = F.aggregate(near, before, enough)

    def first_kind(w: Column) -> Column:
        none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("value"))
        found = F.array(*(F.struct(F.lit(kind).alias("kind"), reading(kind, w).alias("value")) for kind in PATTERNS))
        return F.coalesce(F.get(F.filter(found, lambda r: r["value"].isNotNull()), F.lit(0)), none)

    def measured(r: Column) -> Column:
        n = F.length(r["value"])
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("over"))
        reach = F.aggregate(near, start, lambda s, p: F.when(s["n"] < n, F.struct((s["n"] + F.length(p)).alias("n"), (s["over"] + 1).alias("over"))).otherwise(s))
        return F.struct(r["kind"].alias("kind"), r["value"].alias("value"), n.alias("n"), F.length(F.get(parts, i)).alias("own"), F.greatest(reach["over"], F.lit(1)).alias("over"))

    return F.transform(F.transform(F.array(window), first_kind), measured)[0]


def wanted(reads: Column) -> Column:
    """Array of "1" for readings of the choice without overlaps that covers most characters
    from there on, the earlier one of equals, and "0"."""
    # From the end: characters covered from each of the next parts on, and the marks so far.
    start = F.struct(F.array(F.lit(0)).alias("covered"), F.lit("").alias("marks"))

    def step(s: Column, r: Column) -> Column:
        without = F.get(s["covered"], F.lit(0))
        with_it = r["n"] + F.coalesce(F.get(s["covered"], r["over"] - 1), F.lit(0))
        take = (r["n"] > 0) & (with_it >= without)
        covered = F.slice(F.concat(F.array(F.when(take, with_it).otherwise(without)), s["covered"]), 1, STARTS)
        return F.struct(covered.alias("covered"), F.concat(F.when(take, "1").otherwise("0"), s["marks"]).alias("marks"))

    return F.split(F.aggregate(F.reverse(reads), start, step)["marks"], "")


def consumed(reads: Column, marks: Column) -> Column:
    """Array of text, a sign and a number: whether the part's reading is replaced ("+") and
    how many of the part's characters belong to it or to one before."""
    start = F.struct(F.lit(0).alias("left"), F.lit("").alias("out"))

    def step(s: Column, r: Column) -> Column:
        take = (s["left"] == 0) & (r["mark"] == "1")
        open_ = F.when(take, r["n"]).otherwise(s["left"])
        used = F.least(open_, r["own"])
        sign = F.when(take, "+").otherwise("-")
        return F.struct((open_ - used).alias("left"), F.concat(s["out"], sign, used.cast("string"), F.lit(",")).alias("out"))

    both = F.zip_with(reads, marks, lambda r, m: F.struct(r["n"].alias("n"), r["own"].alias("own"), m.alias("mark")))
    return F.split(F.aggregate(both, start, step)["out"], ",")


def pseudonym(read: Column, key: str) -> Column:
    """Pseudonym of a value of a known kind."""
    return reduce(lambda otherwise, kind: F.when(read["kind"] == kind, PSEUDONYMS[kind](read["value"], key)).otherwise(otherwise), PSEUDONYMS, F.lit(""))


def pseudonymised(text: str | Column, key: str) -> Column:
    """Struct (text, kinds): the text with its personal data replaced, and the kinds in
    order of appearance. Null stays null.

    What stands next to a value in the same format (an expiry, a bank's code, a leading
    number) stays as it is, unless it makes a valid value of its own.
    """
    col = F.col(text) if isinstance(text, str) else text

    def written(s: Column) -> Column:
        """Struct (text, kind) of each part; s has parts, reads and what is consumed of them."""

        def part(i: Column) -> Column:
            use, read = F.get(s["use"], i), F.get(s["reads"], i)
            take = use.startswith("+")
            rest = F.substring(F.get(s["parts"], i), F.substring(use, 2, 12).cast("int") + 1, read["own"])
            return F.struct(
                F.concat(F.when(take, pseudonym(read, key)).otherwise(""), rest).alias("text"),
                F.when(take, read["kind"]).alias("kind"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(s["parts"]) - 1), part)

    # Arrays of one again: each step is evaluated once for those that follow.
    steps = F.transform(F.array(F.split(col, START, -1)), lambda p: F.struct(p.alias("parts"), F.transform(p, lambda _, i: read_at(p, i)).alias("reads")))
    steps = F.transform(steps, lambda s: F.struct(s["parts"].alias("parts"), s["reads"].alias("reads"), consumed(s["reads"], wanted(s["reads"])).alias("use")))
    done = F.transform(F.transform(steps, written), lambda w: F.struct(F.array_join(w["text"], "").alias("text"), F.filter(w["kind"], lambda k: k.isNotNull()).alias("kinds")))
    return F.when(col.rlike("[0-9@]"), done[0]).otherwise(F.struct(col.alias("text"), F.array().cast("array<string>").alias("kinds")))


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_replaced and the number of each kind, for every row.

    Null texts stay null with counts of 0; empty texts stay empty; repeated rows and null
    ids stay as they are; other columns are ignored. One pass, no shuffle, no Python.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), pseudonymised(text, key).alias("done"))
    kinds = F.coalesce(F.col("done.kinds"), F.array().cast("array<string>"))
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).alias(f"n_{kind}") for kind in PATTERNS]
    return rows.select("doc_id", F.col("done.text").alias("text"), F.size(kinds).alias("n_replaced"), *counts)
