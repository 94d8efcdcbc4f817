"""Tokens for entities. A factory turns the entities of a text into an array of tokens, one for each.

What a token preserves of its entity is told by the classes below; conversations need
tokens that tell entities apart.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.schema import let

# ---------------------------------------------------------------- what a token preserves


class Preserves:
    """Nothing is known of what the token preserves."""


class PreservesNothing(Preserves):
    pass


class PreservesLabel(Preserves):
    """Entities of a label share a token."""


class PreservesIdentity(Preserves):
    """Each entity has its own token."""


class PreservesLabeledIdentity(PreservesLabel, PreservesIdentity):
    pass


class PreservesIdentityHashed(PreservesIdentity):
    """The same in every text."""


class PreservesLabeledIdentityHashed(PreservesLabeledIdentity, PreservesIdentityHashed):
    pass


class PreservesLabeledIdentityFaker(PreservesLabeledIdentity):
    """A realistic value."""


class PreservesShape(Preserves):
    """Parts of the value."""


def preservation(factory: Factory) -> type[Preserves]:
    return factory.preserves


def check_identity(factory: Factory) -> None:
    """Conversations restore by token, so tokens that several entities share are refused; undeclared ones are accepted."""
    kind = preservation(factory)
    if kind is not Preserves and not issubclass(kind, PreservesIdentity):
        raise ValueError(f"{type(factory).__name__} gives different entities the same token")


# ---------------------------------------------------------------- factories


class Factory:
    preserves: type[Preserves] = Preserves

    def tokens(self, entities: Column) -> Column:
        """array<string>, in the order of the entities."""
        return let(entities, lambda own: F.transform(own, lambda e, i: self.token(e, i, own)))

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        raise NotImplementedError


def _number(entity: Column, index: Column, entities: Column) -> Column:
    """The entity's number among those of its label, from 1."""
    return F.size(F.filter(F.slice(entities, F.lit(1), index + 1), lambda o: o["label"] == entity["label"])).cast("string")


class Redact(Factory):
    preserves = PreservesNothing

    def __init__(self, value: str = "REDACT") -> None:
        self.value = value

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        return F.lit(f"<<{self.value}>>")


class Label(Factory):
    preserves = PreservesLabel

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        return F.concat(F.lit("<<"), entity["label"], F.lit(">>"))


class LabelCounter(Factory):
    preserves = PreservesLabeledIdentity

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        return self.numbered(entity["label"], _number(entity, index, entities))

    def numbered(self, label: Column, number: Column) -> Column:
        return F.concat(F.lit("<<"), label, F.lit(":"), number, F.lit(">>"))


class RedactCounter(Factory):
    preserves = PreservesIdentity

    def __init__(self, prefix: str = "REDACT") -> None:
        self.prefix = prefix

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        return F.concat(F.lit(f"<<{self.prefix}:"), (index + 1).cast("string"), F.lit(">>"))


PEPPER_VARIABLE = "CLOAKFRAME_PEPPER"


def resolve_pepper(pepper: str | None) -> str:
    """None asks the environment of the driver; an empty text is no pepper."""
    return os.environ.get(PEPPER_VARIABLE, "") if pepper is None else pepper


def hashed(canonical: Column, label: Column, salt: str = "", pepper: str = "", length: int = 8) -> Column:
    """First digits of the SHA-256 of ``text:label`` or, with salt or pepper, ``text:label:salt:pepper``."""
    parts = [canonical, label] + ([F.lit(salt), F.lit(pepper)] if salt or pepper else [])
    return F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, length)


class _Hashed(Factory):
    def __init__(self, hash_length: int = 8, salt: str = "", pepper: str | None = None) -> None:
        if not 1 <= hash_length <= 64:
            raise ValueError("hash_length is from 1 to 64")
        self.length, self.salt, self.pepper = hash_length, salt, resolve_pepper(pepper)

    def digest(self, entity: Column) -> Column:
        return hashed(entity["canonical"], entity["label"], self.salt, self.pepper, self.length)


class LabelHash(_Hashed):
    preserves = PreservesLabeledIdentityHashed

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        return F.concat(F.lit("<<"), entity["label"], F.lit(":"), self.digest(entity), F.lit(">>"))


class RedactHash(_Hashed):
    """The label stays part of what is hashed."""

    preserves = PreservesIdentityHashed

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        return F.concat(F.lit("<<REDACT:"), self.digest(entity), F.lit(">>"))


# Labels that are masked as numbers.
NUMERIC_LABELS = (
    "credit_card", "phone", "phone_international", "us_phone", "fr_phone", "de_phone", "ssn", "us_ssn",
    "fr_ssn", "iban", "eu_iban", "uk_nhs", "us_ein", "us_bank_routing", "ip_address",
)


def mask_default(text: Column, char: str = "*") -> Column:
    """First character and stars."""
    return F.when(F.length(text) <= 1, text).otherwise(F.concat(F.substring(text, 1, 1), F.repeat(F.lit(char), F.length(text) - 1)))


def mask_email(text: Column, char: str = "*") -> Column:
    """First character of the local part, stars, and the domain."""
    at = F.locate("@", F.substring(text, 2, 1 << 30))
    masked = F.concat(F.substring(text, 1, 1), F.repeat(F.lit(char), at - 1), F.substring(text, at + 1, F.length(text)))
    return F.when((at > 0) & (F.length(text) > at + 1), masked).otherwise(mask_default(text, char))


def mask_numeric(text: Column, char: str = "*", visible: int = 4) -> Column:
    """The last digits; a text with no more digits than are visible stays as it is."""
    digits = F.regexp_replace(text, r"[^\p{Nd}]", "")
    n = F.length(digits)
    return F.when(n <= visible, text).otherwise(F.concat(F.repeat(F.lit(char), n - visible), F.substring(digits, n - visible + 1, F.lit(visible))))


class Mask(Factory):
    """By lower-case label, as `strategies` say (text, char) -> masked; own strategies replace the built-in ones."""

    preserves = PreservesShape

    def __init__(self, char: str = "*", visible: int = 4, strategies: dict[str, Callable[[Column, str], Column]] | None = None) -> None:
        self.char = char
        if strategies is None:
            strategies = {"email": mask_email} | {label: (lambda t, c: mask_numeric(t, c, visible)) for label in NUMERIC_LABELS}
        self.strategies = {k.lower(): v for k, v in strategies.items()}

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        text, label = entity["detections"][0]["text"], F.lower(entity["label"])
        chosen = mask_default(text, self.char)
        for known, strategy in self.strategies.items():
            chosen = F.when(label == known, strategy(text, self.char)).otherwise(chosen)
        return chosen


# Bases and templates of the realistic tokens.
BASES = {
    "person": "John Doe",
    "location": "Paris",
    "country": "France",
    "address": "12 rue de Paris",
    "email": "{hash}@example.com",
    "url": "https://example.com/{hash}",
}

#: What a strategy may be: a base or template, or an expression on the token's number or hash.
Strategy = str | Callable[[Column], Column]


def _realistic(strategies: dict[str, Strategy], label: Column, key: Column, mark: str, missing: Column) -> Column:
    chosen = missing
    for known, strategy in strategies.items():
        if callable(strategy):
            value = strategy(key)
        elif mark in strategy:
            value = F.replace(F.lit(strategy), F.lit(mark), key)
        else:
            value = F.concat(F.lit(f"{strategy}:"), key)
        chosen = F.when(F.lower(label) == known, value).otherwise(chosen)
    return chosen


def _unknown(label: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no strategy for the label "), label)).cast("string")


class RealisticCounter(Factory):
    """``base:n``, or the template with ``{counter}``; a label without strategy is an error."""

    preserves = PreservesLabeledIdentityFaker

    def __init__(self, strategies: dict[str, Strategy] | None = None) -> None:
        self.strategies = {k.lower(): v for k, v in (BASES if strategies is None else strategies).items()}

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        return _realistic(self.strategies, entity["label"], _number(entity, index, entities), "{counter}", _unknown(entity["label"]))


class RealisticHash(_Hashed):
    """``base:hash``, or the template with ``{hash}``; a label without strategy is an error."""

    preserves = PreservesLabeledIdentityHashed

    def __init__(self, strategies: dict[str, Strategy] | None = None, hash_length: int = 8, salt: str = "", pepper: str | None = None) -> None:
        super().__init__(hash_length, salt, pepper)
        self.strategies = {k.lower(): v for k, v in (BASES if strategies is None else strategies).items()}

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        return _realistic(self.strategies, entity["label"], self.digest(entity), "{hash}", _unknown(entity["label"]))


def pick(values: list[str], key: Column, seed: int = 0) -> Column:
    """One of the values, the same for the same key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def _digits(key: Column, n: int, seed: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10**n)).cast("string"), n, "0")


FIRST_NAMES = ["Alice", "Bruno", "Chloe", "David", "Emma", "Felix", "Greta", "Hugo", "Irene", "Jonas", "Karin", "Louis", "Marta", "Nils", "Olga", "Paul"]
LAST_NAMES = ["Adler", "Bernard", "Costa", "Dubois", "Evans", "Fischer", "Garcia", "Hansen", "Ivanov", "Jensen", "Keller", "Lopez", "Martin", "Novak", "Olsen", "Petit"]
CITIES = ["Lyon", "Porto", "Bergen", "Graz", "Leeds", "Turin", "Ghent", "Malaga", "Basel", "Cork", "Aarhus", "Krakow"]
COUNTRIES = ["France", "Portugal", "Norway", "Austria", "Italy", "Belgium", "Spain", "Ireland", "Denmark", "Poland"]


def realistic_values(seed: int = 0) -> dict[str, Callable[[Column], Column]]:
    """Made-up values by label, from the entity's text."""
    name = lambda k: F.concat_ws(" ", pick(FIRST_NAMES, k, seed), pick(LAST_NAMES, k, seed + 1))
    phone = lambda k: F.concat(F.lit("+1-555-"), _digits(k, 3, seed), F.lit("-"), _digits(k, 4, seed + 1))
    ssn = lambda k: F.concat(F.lit("9"), _digits(k, 2, seed), F.lit("-"), _digits(k, 2, seed + 1), F.lit("-"), _digits(k, 4, seed + 2))
    iban = lambda k: F.concat(F.lit("XX00"), _digits(k, 18, seed))
    out = {
        "person": name,
        "location": lambda k: pick(CITIES, k, seed),
        "email": lambda k: F.concat(F.lower(pick(FIRST_NAMES, k, seed)), F.lit("."), _digits(k, 6, seed), F.lit("@example.com")),
        "credit_card": lambda k: F.concat(F.lit("0000"), _digits(k, 12, seed)),
        "ip_address": lambda k: F.concat(F.lit("192.0.2."), F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(256)).cast("string")),
        "url": lambda k: F.concat(F.lit("https://example.com/"), _digits(k, 8, seed)),
        "address": lambda k: F.concat(_digits(k, 2, seed), F.lit(" Example Street, "), pick(CITIES, k, seed)),
        "country": lambda k: pick(COUNTRIES, k, seed),
    }
    out |= dict.fromkeys(("phone", "phone_international", "us_phone", "fr_phone", "de_phone"), phone)
    out |= dict.fromkeys(("ssn", "us_ssn", "fr_ssn"), ssn)
    return out | dict.fromkeys(("iban", "eu_iban"), iban)


class Realistic(Factory):
    """A made-up value for the entity's text and label, the same in every text and run; ``<LABEL>`` for other labels."""

    preserves = PreservesLabeledIdentityFaker

    def __init__(self, strategies: dict[str, Callable[[Column], Column]] | None = None, seed: int = 0) -> None:
        self.strategies = {k.lower(): v for k, v in (realistic_values(seed) if strategies is None else strategies).items()}

    def token(self, entity: Column, index: Column, entities: Column) -> Column:
        chosen = F.concat(F.lit("<"), F.upper(entity["label"]), F.lit(">"))
        for known, strategy in self.strategies.items():
            chosen = F.when(F.lower(entity["label"]) == known, strategy(entity["canonical"])).otherwise(chosen)
        return chosen
