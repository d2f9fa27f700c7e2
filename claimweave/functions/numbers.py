"""Written numbers, scales, units and currencies to exact decimals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import built_once, let
from .fixed_values import CURRENCIES, SCALES, UNITS
from .keys import comparison_key
from .periods import full_date

#: Fixed value: the form of a written number.
NUMBER = r"(\()?\s*([+-])?\s*((?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d+)?)\s*\)?"
#: A literal and a factor of these types multiply to decimal(38,12) without loss.
LITERAL, FACTOR, EXACT = "decimal(19,6)", "decimal(18,6)", "decimal(38,12)"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _first(conditions: list[tuple[Column, Column]]) -> Column:
    out = F.when(*conditions[0])
    for condition, value in conditions[1:]:
        out = out.when(condition, value)
    return out


def _longest_first(names) -> list[str]:
    return sorted(names, key=len, reverse=True)


def literal(value: Column) -> Column:
    """The first written number without group separators, or null."""
    return F.nullif(F.replace(F.regexp_extract(value, NUMBER, 3), F.lit(","), F.lit("")), F.lit(""))


def parsed_number(value: Column) -> Column:
    magnitude = literal(value).try_cast(LITERAL)
    negative = (F.regexp_extract(value, NUMBER, 2) == "-") | (F.regexp_extract(value, NUMBER, 1) == "(")
    return F.when(negative, -magnitude).otherwise(magnitude).cast(LITERAL)


def quantum(value: Column) -> Column:
    """The resolution of the written number: 10 to minus its decimal places."""
    return _quantum_of(literal(value))


def _quantum_of(literal: Column) -> Column:
    places = F.length(F.split_part(literal, F.lit("."), F.lit(2)))
    return F.element_at(F.array(*(F.lit(q).cast("decimal(12,6)") for q in ("1", "0.1", "0.01", "0.001", "0.0001", "0.00001", "0.000001"))), F.when(places <= 6, places + 1))


def scale_word(value: Column, unit: Column) -> Column:
    """The longest scale word that stands in the unit's or the value's text, or null."""
    text = F.lower(F.concat(F.coalesce(unit, F.lit("")), F.lit(" "), value))
    ordered = _longest_first(SCALES)
    found = F.regexp_extract_all(text, F.lit(f"{_BEFORE}({'|'.join(ordered)})s?{_AFTER}"), F.lit(1))
    return let({"found": found}, lambda t: F.try_element_at(F.filter(F.array(*map(F.lit, ordered)), lambda w: F.array_contains(t["found"], w)), F.lit(1)))


def scale_factor(scale: Column) -> Column:
    pairs = [x for s, f in SCALES.items() for x in (F.lit(s), F.lit(f).cast("decimal(13,0)"))]
    return F.coalesce(F.element_at(F.create_map(*pairs), scale), F.lit(1).cast("decimal(13,0)"))


def unit_text(unit: Column) -> Column:
    return F.when(F.trim(unit) != "", comparison_key(F.replace(unit, F.lit("%"), F.lit(" percent "))))


def _known_unit(text: Column) -> Column:
    """The longest spelling that the text holds as whole words: one pattern looks at each word's start, and only rows in which
    it finds something go through the spellings."""
    spelled = {}
    for unit, dimension, factor, names in UNITS:
        for name in names:
            spelled.setdefault("percent" if name == "%" else name, (name, unit, dimension, factor))
    ordered = _longest_first(spelled)
    found = F.regexp_extract_all(text, F.lit(f"(?<![^ ])(?=({'|'.join(map(re.escape, ordered))})(?![^ ]))"), F.lit(1))
    longest = lambda t: F.filter(F.array(*map(F.lit, ordered)), lambda w: F.array_contains(t["found"], w))[0]
    facts = F.create_map(*[x for w in ordered for x in (F.lit(w), F.struct(*(F.lit(v).alias(n) for n, v in zip(("alias", "unit", "dimension"), spelled[w])), F.lit(spelled[w][3]).cast(FACTOR).alias("factor")))])
    return let({"found": found}, lambda t: F.when(F.size(t["found"]) > 0, F.element_at(facts, longest(t))))


def find_unit(value: Column, unit: Column, scale: Column) -> Column:
    """alias, unit, dimension and factor: known in the unit's text, else in the value's, else the unit's own words."""
    names = "|".join(c for c in CURRENCIES if c.isalpha())

    def chosen(t: Column) -> Column:
        # Whole words, once more because removed neighbours share a space.
        without_scale = F.when(t["scale"].isNull(), t["own"]).otherwise(F.trim(F.regexp_replace(t["own"], F.concat(F.lit(_BEFORE), t["scale"], F.lit(f"s?{_AFTER}")), F.lit(""))))
        left = F.array_join(F.filter(F.split(F.regexp_replace(without_scale, rf"(?i)\b(?:{names})\b", ""), r"\s+"), lambda w: w != ""), " ")
        own = let({"left": left}, lambda x: F.when(x["left"] != "", F.struct(x["left"].alias("alias"), x["left"].alias("unit"), F.lit("custom").alias("dimension"), F.lit(1).cast(FACTOR).alias("factor"))))
        return F.coalesce(_known_unit(t["own"]), _known_unit(unit_text(t["value"])), own)

    return let({"value": value, "own": unit_text(unit), "scale": scale}, chosen)


def currency_given(currency: Column) -> Column:
    cleaned = F.trim(currency)
    pairs = [F.lit(x) for kv in CURRENCIES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(cleaned)), F.when(cleaned.rlike(r"\A[A-Za-z]{3}\z"), F.upper(cleaned)))


def currency_code(currency: Column, value: Column) -> Column:
    seen = [
        (value.rlike(rf"(?i)(?U)\b{t}\b") if t.isalpha() and t.isascii() else F.lower(value).contains(t), F.lit(CURRENCIES[t]))
        for t in _longest_first(CURRENCIES)
    ]
    return F.coalesce(currency_given(currency), _first(seen))


def _form(s: Column) -> Column:
    """The normal form of a struct of value, unit and currency, each step bound once."""
    first = {
        "value": s["value"], "unit": s["unit"], "currency": currency_code(s["currency"], s["value"]), "scale": scale_word(s["value"], s["unit"]),
        "date": full_date(s["value"]), "literal": literal(s["value"]), "key": comparison_key(s["value"]),
    }
    return let(first, lambda t: let({"said": t, "found": find_unit(t["value"], t["unit"], t["scale"])}, _typed))


def _typed(s: Column) -> Column:
    said, found = s["said"], s["found"]
    untyped = said["currency"].isNull() & found["unit"].isNull() & said["value"].rlike("[A-Za-z]") & said["value"].rlike(r"\d")
    is_text = said["date"].isNotNull() | untyped | said["literal"].isNull()
    text = F.coalesce(said["date"].cast("string"), F.when(said["key"] != "", said["key"]), F.lower(said["value"]))
    kept = {"text_value": F.when(is_text, text), "canonical_unit": found["unit"], "dimension": found["dimension"], "canonical_currency": said["currency"]}
    factors = {"scale_by": F.when(~is_text, scale_factor(said["scale"])), "unit_by": F.when(~is_text, F.coalesce(found["factor"], F.lit(1).cast(FACTOR)))}
    return let({"said": said, "kind": F.when(is_text, "text").otherwise("numeric"), **kept, **factors}, _measured)


def _measured(s: Column) -> Column:
    value, numeric = s["said"]["value"], s["kind"] == "numeric"

    def scaled(t: Column, x: Column) -> Column:
        # A scale alone has no decimal places, so it may be larger.
        return F.coalesce((x * t["factor"]).cast(EXACT), F.when(s["unit_by"] == 1, (x * s["scale_by"]).cast(EXACT)))

    fits = F.length(F.split_part(s["said"]["literal"], F.lit("."), F.lit(2))) <= 6
    values = {"factor": (s["scale_by"] * s["unit_by"]).try_cast(FACTOR), "number": F.when(numeric & fits, parsed_number(value)), "step": F.when(numeric, quantum(value))}
    names = ["kind", "text_value", "canonical_unit", "dimension", "canonical_currency", "scale_by", "unit_by"]
    return let(values, lambda t: F.struct(*(s[k].alias(k) for k in names), scaled(t, t["number"]).alias("number"), scaled(t, t["step"]).alias("step")))


#: Spellings of units whose facts are those of the whole text: none holds a word that scales.
_SPELLED = {name: (unit, dimension, factor) for unit, dimension, factor, names in UNITS for name in names if name != "%" and not any(w in SCALES or w.removesuffix("s") in SCALES for w in name.split())}
#: A number that ``NUMBER`` takes whole, with digits that the native types hold, and nothing else.
_PLAIN = r"\A\d{1,13}(?:\.\d{1,6})?\z"


def _plain_form(value: Column, unit: Column, currency: Column) -> Column:
    """The form of a plain number without a unit or with one spelled as known, in lower case: what ``_form`` finds in such rows, by
    lookups. A plain number holds no currency, scale, unit or date."""
    known = F.create_map(*[x for name, (u, d, f) in _SPELLED.items() for x in (F.lit(name), F.struct(F.lit(u).alias("unit"), F.lit(d).alias("dimension"), F.lit(f).cast(FACTOR).alias("factor")))])
    found, one = F.try_element_at(known, unit), F.lit(1).cast(FACTOR)
    factor = F.coalesce(found["factor"], one)
    parts = {
        "kind": F.lit("numeric"), "text_value": F.lit(None).cast("string"), "canonical_unit": found["unit"], "dimension": found["dimension"], "canonical_currency": currency_given(currency),
        "scale_by": F.lit(1).cast("decimal(13,0)"), "unit_by": factor, "number": (value.try_cast(LITERAL) * factor).cast(EXACT), "step": (_quantum_of(value) * factor).cast(EXACT),
    }
    return F.struct(*(v.alias(k) for k, v in parts.items()))


@built_once
def _form_of(value: str, unit: str, currency: str) -> Column:
    v, u, c = map(F.col, (value, unit, currency))
    plain = v.rlike(_PLAIN) & (u.isNull() | u.isin(list(_SPELLED)))
    return F.when(plain, _plain_form(v, u, c)).otherwise(let({"value": v, "unit": u, "currency": c}, _form))


def normalize_values(df: DataFrame, value: str = "value", unit: str = "unit", currency: str = "currency") -> DataFrame:
    """Adds kind, number, text_value, canonical_unit, dimension, canonical_currency, scale_by, unit_by and step.

    ``number`` and ``step`` (the rounding quantum) are decimal(38,12). A number of more than 13 digits
    before or 6 after its point, or a factor of 10^12 and more of a unit's factor other than 1, has kind
    "numeric" and a null number: such rows go through ``exact_numbers`` and ``compare_exactly``.
    """
    out = df.withColumn("_form", _form_of(value, unit, currency))
    names = ["canonical_currency", "kind", "text_value", "canonical_unit", "dimension", "scale_by", "unit_by", "number", "step"]
    return out.withColumns({k: F.col(f"_form.{k}") for k in names}).drop("_form")


def _signed_literal(value: Column) -> Column:
    return F.concat(F.when((F.regexp_extract(value, NUMBER, 2) == "-") | (F.regexp_extract(value, NUMBER, 1) == "("), "-").otherwise(""), literal(value))


def factors_text(value: Column, *factors: Column) -> Column:
    """A written number and its factors as text, for ``compare_exactly``."""
    return F.concat_ws(" ", _signed_literal(value), *(f.cast("string") for f in factors))


def compare_exactly(left: Column, right: Column) -> Column:
    """equal, rounded (different steps whose intervals overlap), and number and step of both sides as text, by
    decimal arithmetic of any length. Sides are texts of ``factors_text``; a null side has null results."""
    @F.pandas_udf("equal boolean, rounded boolean, number_a string, step_a string, number_b string, step_b string")
    def by_hand(lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
        from decimal import Decimal, localcontext

        def parts(side):
            first, *factors = map(Decimal, side.split(" "))
            number, step = first, Decimal(1).scaleb(first.as_tuple().exponent)
            for f in factors:
                number, step = number * f, step * f
            return number + 0, step

        def text(x):
            return format(x.normalize(), "f")

        out = []
        for a, b in zip(lefts, rights):
            with localcontext() as c:
                c.prec = len(a or "") + len(b or "") + 10
                x, y = parts(a) if a else None, parts(b) if b else None
                both = x is not None and y is not None
                equal = x[0] == y[0] if both else None
                rounded = x[1] != y[1] and 2 * abs(x[0] - y[0]) < x[1] + y[1] if both else None
                out.append((equal, rounded, *(map(text, x) if x else (None, None)), *(map(text, y) if y else (None, None))))
        return pd.DataFrame(out, columns=["equal", "rounded", "number_a", "step_a", "number_b", "step_b"], dtype="object")

    return by_hand(left, right)


def exact_numbers(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows of ``normalize_values`` with ``number_text`` and ``step_text``: exact digits of every number and its step, by
    decimal arithmetic in Arrow batches where the native number is null; other rows go through as nulls."""
    @F.pandas_udf("number string, step string")
    def by_hand(literals: pd.Series, scales: pd.Series, units: pd.Series) -> pd.DataFrame:
        from decimal import Decimal, localcontext

        out = []
        with localcontext() as c:
            c.prec = 60 + max((len(x) for x in literals if x is not None), default=0)
            for x, scale, unit in zip(literals, scales, units):
                if x is None:
                    out.append((None, None))
                    continue
                by = Decimal(scale) * Decimal(unit)
                written = Decimal(x)
                out.append(tuple(format((y * by).normalize() + 0, "f") for y in (written, Decimal(1).scaleb(written.as_tuple().exponent))))
        return pd.DataFrame(out, columns=["number", "step"], dtype="object")

    over = (F.col("kind") == "numeric") & F.col("number").isNull()
    asked = [F.when(over, x) for x in (_signed_literal(F.col(value)), F.col("scale_by").cast("string"), F.col("unit_by").cast("string"))]
    # Zeros behind the point go, and a point that nothing follows.
    short = lambda t: F.when(t.contains(".") & ~t.contains("E"), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t)
    plain = lambda c: short(F.col(c).cast("string"))
    # Marked as not deterministic, it is computed here once, not copied into the keys of joins above.
    hard = df.withColumn("_hard", by_hand.asNondeterministic()(*asked))
    return hard.withColumn("number_text", F.coalesce("_hard.number", plain("number"))).withColumn("step_text", F.coalesce("_hard.step", plain("step"))).drop("_hard")


def intervals_meet(x: Column, x_step: Column, y: Column, y_step: Column) -> Column:
    """Whether 2 |x - y| is less than the sum of the steps, for exact digits of any length, natively.

    Digits are laid in columns by place, and the sign of a sum of such columns is found from the highest: beyond a bound that lower places
    can't make up for, it is settled."""
    texts = {"x": x, "y": y, "s": x_step, "t": y_step}
    whole, part = (lambda c, k=k: F.split_part(F.ltrim(c, F.lit("-")), F.lit("."), F.lit(k)) for k in (1, 2))
    widest = lambda cut: F.greatest(*(F.length(cut(c)) for c in texts.values()))

    def laid(said: Column, name: str) -> Column:
        text = said[name]
        places = F.split(F.concat(F.lpad(whole(text), said["whole"], F.lit("0")), F.rpad(part(text), said["part"], F.lit("0"))), "")
        return F.transform(places, lambda d: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(F.startswith(text, F.lit("-")), -1).otherwise(1))

    def below(places: Column) -> Column:
        return F.aggregate(places, F.lit(0), lambda acc, d: F.greatest(F.least(acc * 10 + d, F.lit(1000)), F.lit(-1000))) < 0

    def met(said: Column) -> Column:
        digits = {k: laid(said, k) for k in texts}
        return let(digits, lambda d: below(F.transform(d["x"], lambda v, i: 2 * (v - d["y"][i]) - d["s"][i] - d["t"][i])) & below(F.transform(d["x"], lambda v, i: 2 * (d["y"][i] - v) - d["s"][i] - d["t"][i])))

    return let(texts | {"whole": widest(whole), "part": widest(part)}, met)


def _times(lefts: pd.Series, rights: pd.Series) -> pd.Series:
    """Products of written decimals, rounded half up to twelve decimals; nulls stay."""
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    with localcontext() as c:
        c.prec = 100
        return pd.Series([None if a is None else format((Decimal(a) * Decimal(b)).quantize(Decimal("1e-12"), ROUND_HALF_UP), "f") for a, b in zip(lefts, rights)], dtype="object")


def convert_currency(df: DataFrame, rates: DataFrame, target: str, as_of: str | None = None) -> DataFrame:
    """Converts number and step by dated rates to a base (as_of, currency, rate); adds rate, rate_date and conversion_error.

    A row of an unconverted number keeps it; an error leaves the row's number as it was and names the cause. A product of
    more than 26 digits before the point has a null number, as any such number has; its rate stays for ``compare_exactly``."""
    code = currency_code(F.lit(target), F.lit(target))
    day = rates.where(F.col("as_of") == F.to_date(F.lit(as_of))) if as_of else rates
    source = day.select(F.col("currency").alias("canonical_currency"), F.col("rate").alias("_from"), F.col("as_of").alias("rate_date"))
    goal = day.where(F.col("currency") == code).select(F.col("rate").alias("_to"), F.col("as_of").alias("_day"))
    out = df.join(source, "canonical_currency", "left").join(goal, F.col("rate_date") == F.col("_day"), "left")
    converts = (F.col("kind") == "numeric") & (F.col("canonical_currency") != code)
    error = (
        F.when(F.col("kind") != "numeric", None)
        .when(F.col("canonical_currency").isNull(), "currency conversion requires a source currency")
        .when(code.isNull(), "unsupported target currency")
        .when(converts & (F.col("_from").isNull() | F.col("_to").isNull()), "missing deterministic rate")
    )
    by = F.when(converts, (F.col("_from").cast("decimal(18,8)") / F.col("_to").cast("decimal(18,8)")).cast("decimal(18,8)"))
    out = out.withColumn("conversion_error", error).withColumn("rate", by)
    # Natively where six decimals hold number and product; beyond that by decimal arithmetic, to twelve decimals as any number here.
    product = F.pandas_udf(_times, "string").asNondeterministic()
    for name in ("number", "step"):
        x = F.col(name)
        short = F.when(F.abs(x).try_cast("decimal(20,6)") == F.abs(x), x.try_cast("decimal(20,6)"))
        hard = F.col("rate").isNotNull() & x.isNotNull() & short.isNull()
        out = out.withColumn("_hard", product(F.when(hard, x.cast("string")), F.when(hard, F.col("rate").cast("string"))))
        out = out.withColumn(name, F.when(F.col("rate").isNotNull(), F.coalesce((short * F.col("rate")).try_cast(EXACT), F.col("_hard").try_cast(EXACT))).otherwise(x)).drop("_hard")
    out = out.withColumn("canonical_currency", F.when(error.isNull() & (F.col("kind") == "numeric"), code).otherwise(F.col("canonical_currency")))
    return out.withColumn("rate_date", F.when(F.col("rate").isNotNull(), F.col("rate_date"))).drop("_from", "_to", "_day")
