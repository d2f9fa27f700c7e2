"""Words, factors and codes that results depend on."""

from __future__ import annotations

# Legal forms that end an entity's name, and those before which one more may stand.
LEGAL_SUFFIXES = ["co", "company", "corp", "corporation", "inc", "incorporated", "llc", "llp", "limited", "ltd", "plc", "private", "pvt"]
COMPOUND_SUFFIXES = ["private", "pvt"]

# Scale words and what they multiply by.
SCALES = {
    "hundred": "100", "thousand": "1000", "k": "1000", "lakh": "100000", "lac": "100000", "million": "1000000", "mn": "1000000",
    "crore": "10000000", "cr": "10000000", "billion": "1000000000", "bn": "1000000000", "trillion": "1000000000000", "tn": "1000000000000",
}

# Unit spellings by canonical unit, dimension and factor.
UNITS = [
    ("ratio", "ratio", "0.01", ["%", "percent", "percentage"]),
    ("ratio", "ratio", "1", ["ratio"]),
    ("m", "length", "0.001", ["millimeter", "millimeters", "mm"]),
    ("m", "length", "0.01", ["centimeter", "centimeters", "cm"]),
    ("m", "length", "1", ["meter", "meters", "metre", "metres", "m"]),
    ("m", "length", "1000", ["kilometer", "kilometers", "kilometre", "kilometres", "km"]),
    ("m", "length", "0.0254", ["inch", "inches"]),
    ("m", "length", "0.3048", ["foot", "feet", "ft"]),
    ("m", "length", "1609.344", ["mile", "miles"]),
    ("kg", "mass", "0.000001", ["milligram", "milligrams", "mg"]),
    ("kg", "mass", "0.001", ["gram", "grams", "g"]),
    ("kg", "mass", "1", ["kilogram", "kilograms", "kg"]),
    ("kg", "mass", "1000", ["tonne", "tonnes", "metric ton", "metric tons"]),
    ("s", "duration", "1", ["second", "seconds", "sec"]),
    ("s", "duration", "60", ["minute", "minutes", "min"]),
    ("s", "duration", "3600", ["hour", "hours", "hr"]),
    ("s", "duration", "86400", ["day", "days"]),
]

# Currency spellings and codes.
CURRENCIES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "$": "USD", "us$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR",
    "£": "GBP", "gbp": "GBP", "¥": "JPY", "jpy": "JPY", "cn¥": "CNY", "cny": "CNY",
}

# Months by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"

# Words that tell what the dates of a reporting period mean, and counts of months in words.
RANGE_WORDS = ["to", "through", "until"]
POINT_WORDS = ["as of", "as at", "on"]
MONTH_COUNTS = {"three": 3, "six": 6, "nine": 9, "twelve": 12}
FISCAL_WORDS = ["fy", "fiscal", "financial"]
COUNT_NAMES = {3: "quarter", 12: "year"}

# Suffixes of days.
DAY_SUFFIXES = ["st", "nd", "rd", "th"]

# Predicates that need a cue of founding in their quote, and the cue.
FOUNDING_PREDICATES = ["date of incorporation", "incorporation date", "incorporated on"]
FOUNDING_CUE = r"\b(?:incorporat(?:e|ed|es|ing|ion)|found(?:ed|ing)|establish(?:ed|ment)|formed)\b"

# The ordered checks, classes, and document states.
CHECKS = ["same_entity", "same_predicate", "normalized_value_equality", "rounding", "time_period", "data_vintage", "unit", "currency", "scope"]
CLASSES = ["corroborates", "contradicts", "reconciled", "uncertain"]
STATES = ["queued", "ingesting", "extracting", "verifying", "normalizing", "classifying", "completed", "failed"]
