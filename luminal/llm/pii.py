"""Personal data: format-preserving Feistel pseudonyms on Spark functions alone.

Values that pass their validation (check digits, octets, calendar) are permuted under a key within their own
format. The permutation depends on the value alone, so equal values stay linked across documents, and whoever
has the key can turn it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even, so that the halves of a value come back to their places

#: Candidates, most specific first; fixed values. What may repeat without bound is possessive: Java then takes it in a
#: loop, where it would otherwise call itself for every repeat and run out of stack on a long text.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])|(?<![A-Za-z0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![A-Za-z0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Days in 400 years, after which the calendar repeats, as a product of two numbers.
DAYS = (189, 773)
#: Valid social security numbers: 898 areas (not 000, 666, 9xx), 99 groups, 9999 serials, as a product of two numbers.
SSNS = (898 * 33, 3 * 9999)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _digest(key: Column | str, kind: str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat(key if isinstance(key, Column) else F.lit(key), F.lit(f"/{kind}/"), round_.cast("string"), F.lit("/"), half.cast("string")), 256)


def _rounds(restore: bool) -> Column:
    return F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if restore else range(ROUNDS))])


def _network(left: Column, right: Column, mix, restore: bool) -> Column:
    """Feistel network: (a, b) to (b, a + F(b)) in each round; backwards (a, b) to (b - F(a), a)."""
    first = F.struct(left.alias("a"), right.alias("b"))
    step = (lambda s, r: F.struct(mix(r, s["b"], s["a"]).alias("a"), s["a"].alias("b"))) if restore else (lambda s, r: F.struct(s["b"].alias("a"), mix(r, s["a"], s["b"]).alias("b")))
    return F.aggregate(_rounds(restore), first, step)


def permute_characters(s: Column, key: Column | str, kind: str, restore: bool = False) -> Column:
    """s with each digit moved among digits and each letter among letters of its case; other characters stay."""
    sign = -1 if restore else 1

    def moved(c: Column, by: Column) -> Column:
        turn = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + sign * by, F.lit(n)))
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    def mix(r: Column, a: Column, b: Column) -> Column:
        def each(h: Column) -> Column:
            by = lambda i: F.conv(F.substring(h, i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.array_join(F.transform(F.split(a, ""), lambda c, i: moved(c, by(i))), "")

        return F.when(F.length(a) == 0, a).otherwise(_let(_digest(key, kind, r, b), each))

    half = F.floor(F.length(s) / 2).cast("int")
    out = _network(F.substring(s, F.lit(1), half), F.substring(s, half + 1, F.length(s)), mix, restore)
    return _let(out, lambda o: F.concat(o["a"], o["b"]))


def permute_number(x: Column, sizes: tuple[int, int], key: Column | str, kind: str, restore: bool = False) -> Column:
    """A long from 0 to sizes[0] * sizes[1] - 1, permuted among them."""
    sign = -1 if restore else 1

    def mix(r: Column, a: Column, b: Column) -> Column:
        drawn = F.conv(F.substring(_digest(key, kind, r, b), 1, 12), 16, 10).cast("long")
        modulus = F.when(r % 2 == 0, F.lit(sizes[0])).otherwise(F.lit(sizes[1])).cast("long")
        return F.pmod(a + sign * drawn, modulus)

    out = _network(F.floor(x / sizes[1]).cast("long"), F.pmod(x, F.lit(sizes[1])).cast("long"), mix, restore)
    return _let(out, lambda o: o["a"] * sizes[1] + o["b"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _laid_out(form: Column, fresh: Column, cls: str = "[A-Za-z0-9]") -> Column:
    """form with its characters of cls replaced in turn by those of fresh."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.rlike(cls), F.struct(F.concat(s["out"], F.substring(fresh, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Of all digits, the last counting once."""
    d = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1))
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), d), F.lit(0), lambda s, x: s + x)


def mod97(s: Column) -> Column:
    value = lambda c: F.when(c.between("0", "9"), c.cast("long")).otherwise((F.ascii(c) - 55).cast("long"))
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda m, c: (m * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def _card(v: Column, key: Column | str, restore: bool) -> Column:
    d = _digits(v)
    body = permute_characters(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", restore)
    fresh = _let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(luhn_sum(d) % 10 == 0, _let(fresh, lambda f: _laid_out(v, f))).otherwise(v)


def _iban(v: Column, key: Column | str, restore: bool) -> Column:
    plain = F.regexp_replace(v, " ", "")
    country = F.substring(plain, 1, 2)
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    bban = permute_characters(F.substring(plain, F.lit(5), F.length(plain)), key, "iban", restore)
    fresh = _let(bban, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    return F.when(mod97(turned) == 1, _let(fresh, lambda f: _laid_out(v, f))).otherwise(v)


def _phone(v: Column, key: Column | str, restore: bool) -> Column:
    """The first digit after a plus stays, as part of the country's code."""
    d = _digits(v)
    keep = F.when(F.startswith(v, F.lit("+")), 1).otherwise(0)
    fresh = F.concat(F.substring(d, F.lit(1), keep), permute_characters(F.substring(d, keep + 1, F.length(d)), key, "phone", restore))
    return F.when(F.length(d).between(8, 15), _let(fresh, lambda f: _laid_out(v, f))).otherwise(v)


def _ip(v: Column, key: Column | str, restore: bool) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda o: o.cast("long"))
    x = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    show = lambda y: F.concat_ws(".", *[F.pmod(F.shiftright(y, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.array_max(octets) < 256, _let(permute_number(x, (1 << 16, 1 << 16), key, "ip", restore), show)).otherwise(v)


def _date(v: Column, key: Column | str, restore: bool) -> Column:
    """yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy, and dd/mm/yyyy where the month is above 12. Within 400 years of it,
    where all weekdays and leap years come round."""
    iso, a, b = F.substring(v, 5, 1) == "-", F.substring(v, 1, 2), F.substring(v, 4, 2)
    month_first = (F.substring(v, 3, 1) == "/") & (a.cast("int") <= 12)
    year = F.when(iso, F.substring(v, 1, 4)).otherwise(F.substring(v, 7, 4))
    text = F.when(iso, v).when(month_first, F.concat_ws("-", year, a, b)).otherwise(F.concat_ws("-", year, b, a))
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    n = F.datediff(day, F.lit("2000-01-01").cast("date")).cast("long")
    size = DAYS[0] * DAYS[1]
    fresh = permute_number(F.pmod(n, F.lit(size)), DAYS, key, "date", restore) + F.floor(n / size) * size
    moved = F.date_add(F.lit("2000-01-01").cast("date"), fresh.cast("int"))

    def show(m: Column) -> Column:
        # a day and month that could be read the other way round are written so that they cannot be mistaken
        y, mo, d = (F.date_format(m, p) for p in ("yyyy", "MM", "dd"))
        return F.when(iso, F.concat_ws("-", y, mo, d)).when(F.substring(v, 3, 1) == ".", F.concat_ws(".", d, mo, y)).when(month_first | (d.cast("int") <= 12), F.concat_ws("/", mo, d, y)).otherwise(F.concat_ws("/", d, mo, y))

    return F.when(day.isNull() | (F.year(day) < 1), v).otherwise(_let(moved, show))


def _ssn(v: Column, key: Column | str, restore: bool) -> Column:
    area, group, serial = (F.substring(v, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    x = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def show(y: Column) -> Column:
        at = F.floor(y / (99 * 9999))
        part = lambda n, width: F.lpad(n.cast("string"), width, "0")
        return F.concat_ws("-", part(at + F.when(at >= 665, 2).otherwise(1), 3), part(F.pmod(F.floor(y / 9999), F.lit(99)) + 1, 2), part(F.pmod(y, F.lit(9999)) + 1, 4))

    return F.when(valid, _let(permute_number(x, SSNS, key, "ssn", restore), show)).otherwise(v)


def _email(v: Column, key: Column | str, restore: bool) -> Column:
    at = F.instr(v, "@")
    return F.concat(permute_characters(F.substring(v, F.lit(1), at - 1), key, "email", restore), F.substring(v, at, F.length(v)))


def pseudonym(v: Column, key: Column | str, restore: bool = False) -> Column:
    """What stands for v; v itself if it passes no validation."""
    made = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}
    out = v
    for kind in reversed(made):
        pattern = PATTERNS[kind].replace(r"\2", r"\1")
        out = F.when(v.rlike("^(?:" + pattern + ")$"), made[kind](v, key, restore)).otherwise(out)
    return out


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", restore: bool = False) -> DataFrame:
    """One row per row of df: id_col, text (with pseudonyms), n_candidates, n_values (how many were replaced).

    Every candidate of a text is judged, however long the text. A null text stays null, with no values; an empty one
    stays empty; rows that repeat give equal rows; an empty table stays empty. restore with the same key gives
    back what was replaced. The key, which must not be empty, is data and no literal: no plan or event log shows it."""
    if not key:
        raise ValueError("a key is needed")
    t = F.col("_t")
    secret = df.sparkSession.createDataFrame([(key,)], "key string").scalar()
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), secret.alias("_key"))
    may = t.rlike("[0-9@]")
    found = F.when(may, F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    rows = base.withColumn("_found", found).withColumn("_new", F.transform("_found", lambda v: pseudonym(v, F.col("_key"), restore)))
    rebuilt = F.array_join(F.zip_with(F.split(t, ANY, -1), F.col("_new"), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    some = F.coalesce(F.size("_found") > 0, F.lit(False))
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda c: c))
    return rows.select(
        F.col("_id").alias(id_col), F.when(some, rebuilt).otherwise(t).alias("text"),
        F.when(some, F.size("_found")).otherwise(0).cast("long").alias("n_candidates"), F.when(some, changed).otherwise(0).cast("long").alias("n_values"),
    )
