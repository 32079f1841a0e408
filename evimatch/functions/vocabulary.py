"""The words, ids and patterns that results depend on.  They are stated plainly; logic lives elsewhere."""

from __future__ import annotations

import unicodedata

MANUFACTURERS = ["Topps", "Panini", "Upper Deck", "Donruss", "Fleer", "Leaf", "Score", "Bowman", "SkyBox", "Pacific", "Playoff", "Pinnacle", "O-Pee-Chee", "Press Pass", "Futera", "Cryptozoic", "Rittenhouse", "Konami"]
PRODUCTS = [
    "Chrome", "Prizm", "Select", "Optic", "Mosaic", "Heritage", "Stadium Club", "Finest", "Sapphire", "Chronicles", "Absolute", "Certified", "Contenders", "Origins", "Revolution", "Crown Royale",
    "Court Kings", "Hoops", "Flawless", "Immaculate", "National Treasures", "Noir", "Obsidian", "Phoenix", "Spectra", "Illusions", "Allen & Ginter", "Gypsy Queen", "Archives", "Tribute", "Inception", "Luminance",
]
LEAGUES = {"NFL": "Football", "NBA": "Basketball", "WNBA": "Basketball", "MLB": "Baseball", "NHL": "Hockey", "MLS": "Soccer", "NASCAR": "Racing", "UFC": "MMA", "WWE": None, "AEW": None}
FINISHES = ["superfractor", "xfractor", "x-fractor", "refractor", "holofoil", "holo", "foil", "shimmer", "mojo", "atomic", "pulsar", "sparkle", "lazer", "cracked ice", "rainbow"]
NOT_A_NAME = (
    "rookie rc card cards trading licensed product official series edition limited autograph auto signature jersey patch relic base insert allstar all-star draft picks future stars legends legend hall fame champion"
    " mvp pts reb ast sp ssp the company inc llc ltd rights reserved made usa all guard forward center centre pitcher catcher quarterback receiver defense striker midfielder goalkeeper wrestler superstar superstars"
).split()
VARIANTS = [
    ("reverse holo", ["reverse holo", "reverse foil", "rev holo"]),
    ("holo", ["holo", "holofoil", "holographic"]),
    ("first edition", ["1st edition", "first edition", "1. auflage", "edition 1"]),
    ("unlimited", ["unlimited"]),
    ("promo", ["promo", "promotional", "black star promo"]),
    ("refractor", ["refractor"]),
    ("prizm", ["prizm"]),
    ("chrome", ["chrome"]),
    ("foil", ["foil"]),
    ("shadowless", ["shadowless"]),
]
#: The accented French hint never matches folded text; it is kept because results depend on it.
LANGUAGE_HINTS = [
    ("de", ["basis-set", "grundschule", "stufe 1", "entwicklungsstufe", "schaden", "lebenspunkte", "illustrator"]),
    ("fr", ["niveau", "illustrateur", "points de vie", "dégâts"]),
    ("es", ["nivel", "ilustrador", "puntos de vida"]),
    ("it", ["livello", "illustratore", "punti vita"]),
]
#: Letters read for digits.
CONFUSED, CONFUSED_AS = "OoQDIli|SsBZzGT", "000011115582267"
CATEGORIES = {"ccg": 183454, "sports": 261328, "nonsport": 183050}
CONDITIONS = {"near mint or better": 400010, "so gut wie neu": 400010, "excellent": 400011, "exzellent": 400011, "very good": 400012, "sehr gut": 400012, "poor": 400013, "schlecht": 400013, "near mint": 400010}
GRADERS = [
    (275010, "Professional Sports Authenticator", "PSA"), (275011, "Beckett Collectors Club Grading", "BCCG"), (275012, "Beckett Vintage Grading", "BVG"), (275013, "Beckett Grading Services", "BGS"),
    (275014, "Certified Sports Guaranty", "CSG"), (275016, "Sportscard Guaranty Corporation", "SGC"), (275017, "K Sportscard Authentication", "KSA"), (275018, "Gem Mint Authentication", "GMA"),
    (275019, "Hybrid Grading Approach", "HGA"), (2750110, "International Sports Authentication", "ISA"), (2750112, "Gold Standard Grading", "GSG"), (2750113, "Platin Grading Service", "PGS"),
    (2750114, "MNT Grading", "MNT"), (2750115, "Technical Authentication & Grading", "TAG"), (2750116, "Rare Edition", None), (2750117, "Revolution Card Grading", "RCG"),
    (2750120, "Card Grading Australia", "CGA"), (2750121, "Trading Card Grading", "TCG"), (2750123, "Other", None),
]
GRADES = {
    "10": 275020, "9.5": 275021, "9": 275022, "8.5": 275023, "8": 275024, "7.5": 275025, "7": 275026, "6.5": 275027, "6": 275028, "5.5": 275029, "5": 2750210, "4.5": 2750211, "4": 2750212,
    "3.5": 2750213, "3": 2750214, "2.5": 2750215, "2": 2750216, "1.5": 2750217, "1": 2750218, "Authentic": 2750219, "Authentic Altered": 2750220, "Authentic - Trimmed": 2750221, "Authentic - Colored": 2750222,
}
DESCRIPTORS = {"40001": "cardConditionId", "27501": "graderId", "27502": "gradeId", "27503": "certificationNumber"}
DESCRIPTOR_WORDS = {"card condition": "cardConditionId", "professional grader": "graderId", "grade": "gradeId", "certification number": "certificationNumber"}
HEADER_ALIASES = {
    "title": ["title", "titel", "item title", "artikelbezeichnung", "listing title"],
    "description": ["description", "beschreibung", "item description"],
    "price": ["price", "preis", "startpreis", "start price", "buy it now price", "sofort kaufen preis"],
    "quantity": ["quantity", "menge", "anzahl"],
    "sku": ["custom label", "custom label sku", "sku", "artikelnummer"],
    "conditionId": ["condition id", "conditionid", "zustand id"],
    "condition": ["condition", "zustand"],
    "category": ["category", "kategorie", "category id", "primary category"],
    "action": ["action", "aktion"],
    "format": ["format", "listing format", "angebotsformat"],
    "duration": ["duration", "listing duration", "angebotsdauer", "laufzeit"],
    "name": ["character", "player", "spieler", "card name", "kartenname"],
    "number": ["card number", "kartennummer", "number"],
    "set": ["set", "serie", "card set", "kartenserie"],
    "year": ["year", "jahr", "year manufactured"],
    "manufacturer": ["manufacturer", "hersteller", "brand", "marke"],
    "game": ["game", "spiel", "tcg"],
    "language": ["language", "sprache"],
    "sport": ["sport", "sportart"],
    "league": ["league", "liga"],
    "team": ["team", "mannschaft"],
    "serial": ["print run", "serial number", "numbered", "auflage"],
    "variant": ["parallel variety", "variant", "variante", "features", "finish"],
    "grade": ["grade", "bewertung"],
    "gradingCompany": ["professional grader", "grader", "grading company"],
}
STARTER_HEADERS = [
    "Action(SiteID=Germany|Country=DE|Currency=EUR|Version=1193|CC=UTF-8)", "Category ID", "Title", "Condition ID", "CD:Card Condition - (ID: 40001)", "CD:Professional Grader - (ID: 27501)",
    "CD:Grade - (ID: 27502)", "CDA:Certification Number - (ID: 27503)", "Start price", "Quantity", "Format", "Duration", "Description", "Item photo URL",
]
#: Legal edges of a card's life.
TRANSITIONS = [
    ("UPLOADED", "PROCESSING"), ("UPLOADED", "FAILED"), ("PROCESSING", "IDENTIFIED"), ("PROCESSING", "NEEDS_REVIEW"), ("PROCESSING", "FAILED"), ("IDENTIFIED", "NEEDS_REVIEW"), ("IDENTIFIED", "VERIFIED"),
    ("IDENTIFIED", "PROCESSING"), ("NEEDS_REVIEW", "VERIFIED"), ("NEEDS_REVIEW", "FAILED"), ("NEEDS_REVIEW", "PROCESSING"), ("VERIFIED", "READY"), ("VERIFIED", "NEEDS_REVIEW"), ("READY", "EXPORTED"),
    ("READY", "NEEDS_REVIEW"), ("EXPORTED", "READY"), ("EXPORTED", "NEEDS_REVIEW"), ("FAILED", "PROCESSING"),
]
WEIGHTS = {"number": 3.0, "name": 2.0, "set": 1.5, "year": 1.0, "hp": 0.8, "language": 0.5, "variant": 0.5}


def _accents() -> tuple[str, str]:
    """Latin letters that lose a mark, and the marks themselves (which have no counterpart and so are deleted)."""
    take, give = "", ""
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(bare) == 1 and bare != chr(code):
            take, give = take + chr(code), give + bare
    return take + "".join(map(chr, range(0x300, 0x370))), give


ACCENTED, PLAIN = _accents()
SPACES = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: The fields that identify a card, and those that only users fill.
FIELDS_OF_CARD = ["name", "number", "set", "series", "year", "manufacturer", "brand", "game", "sport", "team", "league", "language", "region"]
USER_FIELDS = ["condition", "gradingCompany", "grade", "certNumber", "graded", "cardType", "quantity", "sku", "sellerNotes", "price"]
#: Where on a card its name and its number are printed, as parts of its width and height: left, top, width, height.
REGIONS = {"top": (0.02, 0.012, 0.96, 0.13), "bottomLeft": (0.0, 0.9, 0.42, 0.1), "bottomRight": (0.55, 0.9, 0.45, 0.1)}
#: A strip is enlarged to this height, and has a margin as wide as this.
STRIP_HEIGHT, STRIP_MARGIN = 240, 12
