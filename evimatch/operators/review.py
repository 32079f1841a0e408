"""What a person does with records: corrections, promoted candidates, defaults, review lists, and the rows that are exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimatch.functions import market, values
from evimatch.functions.vocabulary import FIELDS_OF_CARD, USER_FIELDS
from evimatch.operators import records


def correct(cards: DataFrame, field: str, value: Column, where: Column | None = None) -> DataFrame:
    """Cards with a user's value in a field and without that field's flag, for the rows that ``where`` names (all without it).

    What only users say lies in columns user_<field> ('' takes it back); any other field becomes a value of the user's, which is certain.
    """
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    name = f"user_{field}" if field in USER_FIELDS else field
    new = F.nullif(value.cast("string"), F.lit("")) if field in USER_FIELDS else values.extracted(value, "user", F.lit(1.0), F.lit("user correction"))
    return cards.withColumns({name: F.when(chosen, new).otherwise(F.col(name)), "flags": F.when(chosen, F.array_remove("flags", field)).otherwise(F.col("flags"))})


def apply_candidate(cards: DataFrame, fields: tuple[str, ...], prefix: str = "c_") -> DataFrame:
    """Cards whose candidate (columns c_<field>, c_confidence) is taken over as the user's own word; only the variant flag stays."""
    given = {f: F.when(F.col(f"{prefix}{f}").isNotNull(), values.extracted(F.col(f"{prefix}{f}"), "user", F.lit(1.0), F.lit("user correction"))).otherwise(F.col(f)) for f in fields}
    return cards.withColumns({**given, "confidence": F.col(f"{prefix}confidence"), "flags": F.filter("flags", lambda x: x == "variant")})


def override_name(name: Column, known: Column, agreement: Column, confidence: Column, known_id: Column) -> Column:
    """The catalogue's spelling where it agrees (0.75) with what was read and differs; what was read stays as the evidence."""
    read = name["value"]
    evidence = F.concat(known_id.cast("string"), F.lit(" (read as “"), read, F.lit("”)"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    differs = (agreement >= 0.75) & (known != read) & (read != "") & (known != "")
    return F.when(F.coalesce(differs, F.lit(False)), values.extracted(known, "db_match", sure, evidence)).otherwise(name)


def with_default(own: Column, default: Column, allowed: Column | None = None) -> Column:
    """A card's own value, else the batch's default ('' is none), where it is allowed."""
    given = F.nullif(default.cast("string"), F.lit(""))
    return F.coalesce(F.nullif(own.cast("string"), F.lit("")), given if allowed is None else F.when(allowed, given))


def card_values(cards: DataFrame, defaults: dict[str, str], mark: str = ".") -> DataFrame:
    """What an export says of a card (card_type, game, sport, condition, grader, grade, graded, price, quantity): ids, price, quantity.

    The default condition is not for graded cards; without a quantity there is one card.
    """
    default = lambda f: F.lit(defaults.get(f))
    graded = market.is_graded(F.col("graded"), F.col("grader"), F.col("grade"), F.col("condition"))
    kind = market.card_type(with_default(F.col("card_type"), default("card_type")), F.col("game"), F.col("sport"))
    condition = with_default(F.col("condition"), default("condition"), ~F.coalesce(graded, F.lit(False)))
    price = with_default(F.col("price"), default("price"))
    return cards.withColumns(
        {
            "category": market.category_id(kind),
            "card_condition": F.when(~F.coalesce(graded, F.lit(False)), market.condition_id(condition)),
            "grader_id": F.when(graded, market.grader_id(F.col("grader"))),
            "grade_id": F.when(graded, market.grade_id(F.col("grade"))),
            "price": market.price(price, mark),
            "quantity": F.coalesce(F.nullif(F.col("quantity").cast("string"), F.lit("")), F.lit("1")),
        }
    )


def to_review(cards: DataFrame) -> DataFrame:
    return cards.where((F.col("state") == "NEEDS_REVIEW") | (F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0))


def in_state(cards: DataFrame, which: str) -> DataFrame:
    """all, review, failed, or ready, which is neither."""
    keep = {"all": F.lit(True), "review": F.col("state") == "NEEDS_REVIEW", "failed": F.col("state") == "FAILED", "ready": ~F.col("state").isin("NEEDS_REVIEW", "FAILED")}
    return cards.where(keep[which])


def visible(cards: DataFrame, which: str, needle: str, fields: list[str], identity: Column, **page) -> DataFrame:
    """What a list of cards shows: those of in_state(), or 'duplicates', cards that share their identity with another; then search_page()."""
    if which == "duplicates":
        twice = records.duplicates(cards, identity)
        kept = cards.join(twice, identity == twice["key"], "left_semi")
    else:
        kept = in_state(cards, which)
    return records.search_page(kept, needle.strip(), fields, **page)


def prune(selection: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """The selected keys that are still shown."""
    return selection.select(key).distinct().join(visible.select(key), key, "left_semi")


def generic_line(title: Column, fields: dict[str, Column], confidence: Column, state: Column, more: tuple[str, ...] = ("variant", "condition", "quantity", "sku", "price")) -> Column:
    """One line of the generic export: title, identification, what a seller adds, confidence and state; numbers and the like as text."""
    names = ["title", *FIELDS_OF_CARD, *more, "confidence", "status"]
    known = {"title": title, **fields, "confidence": confidence, "status": state}
    as_text = ("number", "serial", "sku", "certNumber")
    cells = [market.csv_field(F.coalesce(known[n].cast("string"), F.lit("")) if n in known else F.lit(""), ",", n in as_text) for n in names]
    return F.concat_ws(",", *cells)


def generic_header(more: tuple[str, ...] = ("variant", "condition", "quantity", "sku", "price")) -> str:
    return ",".join(["title", *FIELDS_OF_CARD, *more, "confidence", "status"])


def tab_line(columns: list[Column]) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def write_json(cards: DataFrame, path: str) -> None:
    """Whole records, one JSON object a line, nulls included."""
    cards.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def is_image(kind: Column, name: Column) -> Column:
    """Whether a file may come in as a photo: by its media type, never a spreadsheet."""
    return F.coalesce(F.lower(kind).startswith("image/"), F.lit(False)) & ~F.coalesce(F.lower(name).endswith(".xlsx"), F.lit(False))
