"""Operator 8, PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

One pattern finds candidates; each kind is validated, keyed-permuted within its
own format and put back, separators and all, so that equal values have equal
pseudonyms in every document, also where they are written differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Demonstration key of the registered query; a caller passes a secret one.
KEY = "moothall-demo-key"
ROUNDS = 8

_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"
_ISO = r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
_DAY_FIRST = r"(?<![0-9])[0-9]{2}([/.])[0-9]{2}[/.][0-9]{4}(?![0-9])".replace("([/.])", "[/.]")
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
_PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])"
_SOCIAL = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
_NUMBER = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
_SECRET = r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
KINDS = {"email": _EMAIL, "ip": _IP, "iso_date": _ISO, "date": _DAY_FIRST, "social": _SOCIAL, "phone": _PHONE, "secret": _SECRET, "number": _NUMBER}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Texts without a match of this have none of PATTERN either.
_MAYBE = r"@|[0-9][^0-9]{0,2}[0-9]|[0-9a-f]{32}|[0-9A-F]{32}"
#: Dates are permuted as days from 1900-01-01 on, 250 * 292 of them, up to 2099-11-13.
_DAYS = (250, 292)


def _hash(key: Column, tweak: Column, i: Column, x: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), x.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permute(left: Column, right: Column, a: Column, b: Column, key: Column, tweak: Column) -> Column:
    """A keyed permutation of the pairs (left < a, right < b), as a struct l, r: a Feistel network over unequal halves."""

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((s["l"] + _hash(key, tweak, i, s["r"]) % a) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _hash(key, tweak, i, s["l"]) % b) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permute_digits(d: Column, key: Column, tweak: Column, base: int = 10) -> Column:
    """A keyed permutation of the strings of as many digits of the base (10 or 16), up to 22 of them for base 10."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    number = (lambda x: F.coalesce(F.conv(x, 16, 10).cast("long"), F.lit(0).cast("long"))) if base == 16 else (lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long")))
    text = (lambda x, k: F.lpad(F.lower(F.conv(x.cast("string"), 10, 16)), k, "0")) if base == 16 else (lambda x, k: F.lpad(x.cast("string"), k, "0"))
    size = lambda k: F.pow(F.lit(float(base)), k).cast("long")  # noqa: E731  exact: below 2**53
    got = permute(number(d.substr(F.lit(1), h)), number(d.substr(h + 1, n)), size(h), size(n - h), key, F.concat(tweak, n.cast("string")))
    return F.transform(F.array(got), lambda p: F.concat(F.when(h > 0, text(p["l"], h)).otherwise(""), text(p["r"], n - h)))[0]


def luhn(d: Column) -> Column:
    """The check digit that completes the digits d."""
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda s, i: s + F.transform(F.array(d.substr(i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)), lambda x: F.when(x > 9, x - 9).otherwise(x))[0],
    )
    return (10 - total % 10) % 10


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def put_back(m: Column, d: Column) -> Column:
    """m with its digits replaced by those of d, in order."""
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), d.substr(F.length(digits(m.substr(F.lit(1), i))) + 1, F.lit(1))).otherwise(c)), "")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def is_card(m: Column) -> Column:
    """13 to 19 digits of which the last is the check digit of the others."""
    d = digits(m)
    n = F.length(d)
    return n.between(13, 19) & (luhn(d.substr(F.lit(1), n - 1)) == d.substr(n, F.lit(1)).cast("int"))


def _number(m: Column, key: Column) -> Column:
    """Numbers whose check digit is right are permuted into such numbers; so is one behind or before another number. The rest stay."""

    def card(part: Column) -> Column:
        def new(d: Column) -> Column:
            return _let(permute_digits(d.substr(F.lit(1), F.length(d) - 1), key, F.lit("number")), lambda b: F.concat(b, luhn(b).cast("string")))

        return put_back(part, _let(digits(part), new))

    tail, head = F.regexp_replace(m, r"^[0-9]+[ \-]", ""), F.regexp_replace(m, r"[ \-][0-9]+$", "")
    before, after = m.substr(F.lit(1), F.length(m) - F.length(tail)), m.substr(F.length(head) + 1, F.length(m))
    return F.when(is_card(m), card(m)).when(is_card(tail), F.concat(before, card(tail))).when(is_card(head), F.concat(card(head), after)).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    """The country code after a plus sign stays."""
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3})(?=[ .\-(])", 1)
    rest = m.substr(F.length(code) + 1, F.length(m))
    return F.concat(code, put_back(rest, permute_digits(digits(rest), key, F.lit("phone"))))


def _date(m: Column, key: Column, fmts: tuple[str, ...]) -> Column:
    """Valid dates of the years that are permuted; others stay."""
    out = m
    for fmt in reversed(fmts):
        day = F.datediff(F.try_to_date(m, fmt), F.lit("1900-01-01").cast("date"))
        a, b = (F.lit(x).cast("long") for x in _DAYS)
        new = _let(permute(F.floor(day / _DAYS[1]), day % _DAYS[1], a, b, key, F.lit("date")), lambda p: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * _DAYS[1] + p["r"]).cast("int")), fmt))
        out = F.when(day.between(0, _DAYS[0] * _DAYS[1] - 1), new).otherwise(out)
    return out


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    wide = F.lit(1 << 16).cast("long")
    new = _let(permute(o[0] * 256 + o[1], o[2] * 256 + o[3], wide, wide, key, F.lit("ip")), lambda p: F.concat_ws(".", *((F.floor(p[h] / 256) if i else p[h] % 256).cast("string") for h in "lr" for i in (1, 0))))
    return F.when(F.forall(o, lambda x: x < 256), new).otherwise(m)


def _secret(m: Column, key: Column) -> Column:
    """Sixteen hex digits at a time, each with its place as a tweak; the letters' case stays."""
    new = F.array_join(F.transform(F.sequence(F.lit(1), F.length(m), F.lit(16)), lambda i: permute_digits(F.lower(m.substr(i, F.lit(16))), key, F.concat(F.lit("secret"), i.cast("string")), 16)), "")
    return F.when(m == F.upper(m), F.upper(new)).otherwise(new)


def _email(m: Column, key: Column) -> Column:
    """Addresses have no fixed range to permute: a keyed digest, still an address."""
    h = lambda what: F.substring(F.sha2(F.concat(key, F.lit(f"|{what}|"), F.lower(F.regexp_extract(m, "^[^@]+" if what == "user" else "@(.+)$", 0))).cast("binary"), 256), 1, 16 if what == "user" else 8)
    return F.concat(F.lit("u"), h("user"), F.lit("@d"), h("domain"), F.lit(".invalid"))


def kind_of(m: Column) -> Column:
    out = F.lit("number")
    for kind, p in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(kind: Column, m: Column, key: Column) -> Column:
    return (
        F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "iso_date", _date(m, key, ("yyyy-MM-dd",)))
        .when(kind == "date", F.when(m.contains("/"), _date(m, key, ("dd/MM/yyyy", "MM/dd/yyyy"))).otherwise(_date(m, key, ("dd.MM.yyyy",))))
        .when(kind == "social", put_back(m, permute_digits(digits(m), key, F.lit("social")))).when(kind == "phone", _phone(m, key)).when(kind == "secret", _secret(m, key)).otherwise(_number(m, key))
    )


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """docs with personal values in the text replaced by pseudonyms of the same format.

    kinds_col, if given, names a new array column of the kinds of the values
    that were changed, in order. Null texts stay null, with no kinds; texts
    without matches stay as they are. Values that look like dates, addresses or
    card numbers but aren't valid stay, and have no kind. Every
    other column and every row is kept; texts are handled whole and unmoved.
    """
    text, k = F.col(text_col), F.lit(key)
    found = "__pii_found"
    maybe = text.rlike(_MAYBE)
    out = docs.withColumn(found, F.when(maybe, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: _let(kind_of(m), lambda kind: F.struct(kind.alias("k"), m.alias("m"), pseudonym(kind, m, k).alias("n"))))))
    new = F.transform(F.col(found), lambda s: s["n"])
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), new, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    out = out.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(text))
    if kinds_col:
        out = out.withColumn(kinds_col, F.coalesce(F.transform(F.filter(F.col(found), lambda s: s["n"] != s["m"]), lambda s: s["k"]), F.array().cast("array<string>")))
    return out.drop(found)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), kinds_col="kinds")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_values"), F.array_join(F.sort_array(F.array_distinct("kinds")), ",").alias("kinds"))
