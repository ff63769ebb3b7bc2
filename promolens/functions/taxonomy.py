"""Category taxonomy and the rules that place an offer in it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import rule_text
from .vectors import bind

#: Buckets and their subcategories.
TAXONOMY: dict[str, tuple[str, ...]] = {
    "Lebensmittel": (
        "Obst & Gemüse", "Fleisch & Wurst", "Fisch", "Milchprodukte & Käse", "Brot & Backwaren", "Süßwaren & Snacks", "Tiefkühl", "Grundnahrung & Konserven",
    ),
    "Getränke": ("Wasser & Säfte", "Bier", "Wein & Sekt", "Spirituosen", "Kaffee & Tee"),
    "Drogerie & Kosmetik": ("Körperpflege", "Kosmetik & Make-up", "Gesundheit & Apotheke", "Parfum & Düfte"),
    "Haushalt & Reinigung": ("Waschmittel", "Reinigung", "Küchenbedarf", "Aufbewahrung"),
    "Baby & Kind": ("Windeln & Pflege", "Baby-Nahrung", "Spielzeug"),
    "Tier": ("Hund", "Katze", "Sonstige Tiere"),
    "Garten & Heimwerken": ("Pflanzen & Garten", "Gartenwerkzeug", "Werkzeug & Heimwerken", "Farbe & Bauchemie", "Gartenmöbel"),
    "Elektronik & Multimedia": ("Smartphone & Tablet", "Computer & Drucker", "TV & Audio", "Haushaltsgeräte", "Sonstige Elektronik"),
    "Mode, Sport & Freizeit": ("Kleidung & Schuhe", "Sport & Fitness", "Outdoor", "Spielzeug & Hobby"),
    "Sonstiges": ("Auto & Mobilität", "Büro & Schreibwaren", "Sonstige"),
}
#: Source categories that are one bucket.
SOURCE_TOP = {
    "Elektronik und Technik": "Elektronik & Multimedia",
    "Computer und Software": "Elektronik & Multimedia",
    "Möbel und Wohnen": "Garten & Heimwerken",
    "Heimwerken und Garten": "Garten & Heimwerken",
    "Baby und Kinder": "Baby & Kind",
    "Tierbedarf und Tierfutter": "Tier",
    "Mode und Accessoires": "Mode, Sport & Freizeit",
    "Sport und Freizeit": "Mode, Sport & Freizeit",
    "Saison und Events": "Sonstiges",
    "Dienstleistungen": "Sonstiges",
}
#: Source categories of two buckets, with their default.
SOURCE_DEFAULT = {"Lebensmittel und Getränke": "Lebensmittel", "Drogerie und Haushalt": "Haushalt & Reinigung"}
#: Prefixes of the third path level that decide between the two.
SOURCE_LEVEL3 = (
    ("Marken Lebensmittel", "Lebensmittel"), ("Marken Haushalt", "Haushalt & Reinigung"), ("Getränke", "Getränke"),
    ("Lebensmittel", "Lebensmittel"), ("Drogerie", "Drogerie & Kosmetik"), ("Haushalt", "Haushalt & Reinigung"),
)
#: Store names by their beginning.
SUPERMARKETS = (
    "lidl", "kaufland", "netto", "rewe", "penny", "edeka", "e center", "aldi", r"norma\b", "globus(?!-baumarkt)", "tegut", "nahkauf", "famila",
    "marktkauf", r"hit\b", r"real\b", "v-markt", "wasgau", "feneberg", r"combi\b",
)
DRUGSTORES = ("dm", "rossmann", r"müller\b", "budni")

#: Fixed values: (bucket, subcategory, pattern); first match wins. Words end where ASCII letters, digits or _ do.
BRAND_RULES: tuple[tuple[str, str, str], ...] = (
    ("Elektronik & Multimedia", "Smartphone & Tablet", "iphone|ipad|airpods?"),
    ("Elektronik & Multimedia", "Computer & Drucker", "macbook|imac|mac mini"),
    ("Elektronik & Multimedia", "TV & Audio", "apple tv"),
    ("Haushalt & Reinigung", "Waschmittel", "ariel|persil|lenor|coral|perwoll|spee|weißer riese|dash"),
    ("Haushalt & Reinigung", "Reinigung", "frosch|ajax|febreze|ecover|sagrotan|domestos|finish|somat"),
    ("Tier", "Katze", "felix|whiskas|sheba|gourmet|kitekat|catsan"),
    ("Tier", "Hund", "pedigree|frolic|chappi|cesar|rinti"),
    ("Baby & Kind", "Windeln & Pflege", "pampers|huggies|babylove|lillydoo"),
    ("Baby & Kind", "Baby-Nahrung", "hipp|alete|milupa|aptamil"),
    ("Lebensmittel", "Süßwaren & Snacks", r"funny[\s-]*frisch|chio|lay'?s|pringles|ferrero|milka|ritter[\s-]*sport|haribo|amicelli|m&m'?s|kinder"),
    ("Getränke", "Spirituosen", "aperol|campari|cinzano|martini|jägermeister|absolut|smirnoff|bombay|tanqueray|nordhäuser"),
    ("Getränke", "Bier", r"beck'?s|krombacher|warsteiner|bitburger|veltins|flensburger|feldschlößchen|paulaner"),
    ("Getränke", "Wasser & Säfte", r"coca[\s-]*cola|pepsi|fanta|sprite|fritz[\s-]*kola|afri[\s-]*cola|red bull|gerolsteiner|vio|volvic"),
)
#: Fixed values: (bucket, subcategory, keywords) of titles; first match wins. Another rule set is data: see ``keyword_rules``.
KEYWORD_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Baby & Kind", "Windeln & Pflege", ("windel", "feuchttuch", "babylotion", "babybad", "babyshampoo", "babypfleg")),
    ("Baby & Kind", "Baby-Nahrung", ("babynahrung", "babybrei", "folgemilch", "anfangsmilch", "babykost", "babyglas")),
    ("Baby & Kind", "Spielzeug", (
        "spielzeug", "lego", "playmobil", "puppe", "kuscheltier", "stofftier", "kinderwagen", "kinderbett", "maxi-cosi", "schulranzen", "schultasche",
    )),
    ("Tier", "Hund", ("hundefutter", "hundeleckerli", "hundeleine", "hundehalsband", "hundekauknochen")),
    ("Tier", "Katze", ("katzenfutter", "katzenstreu", "katzenleckerli")),
    ("Tier", "Sonstige Tiere", ("nagerfutter", "vogelfutter", "aquarium", "terrarium", "fischfutter", "kaninchen", "meerschweinchen", "ziervogel")),
    ("Garten & Heimwerken", "Gartenwerkzeug", (
        "rasenmäher", "rasenmaeher", "heckenschere", "akku-heckenschere", "akku-rasenmäher", "akku-rasenmaeher", "kettensäge", "kettensaege",
        "akku-kettensäge", "astschere", "gartenschere", "laubbläser", "vertikutierer", "akku-bohrschrauber",
    )),
    ("Garten & Heimwerken", "Pflanzen & Garten", ("pflanze", "blume ", "azalee", "samen", "dünger", "duenger", "rasensaat", "blumenkasten")),
    ("Garten & Heimwerken", "Gartenmöbel", (
        "ampelschirm", "faltpavillon", "feuerschale", "gartenstuhl", "gartentisch", "auflagenbox", "abdeckhaube", "anzündkamin", "anzuendkamin", "briketts",
        "grill",
    )),
    ("Garten & Heimwerken", "Farbe & Bauchemie", ("wandfarbe", "lack", "alpina", "farbroller", "silikon", "klebstoff", "fliese")),
    ("Garten & Heimwerken", "Werkzeug & Heimwerken", (
        "werkzeug", "bohrmaschine", "akkuschrauber", "säge ", "saege ", "hammer", "schraube", "dübel", "duebel", "leiter ", "kabeltrommel", "verlängerung",
        "verlaengerung",
    )),
    ("Elektronik & Multimedia", "Smartphone & Tablet", ("smartphone", "handy ", "tablet", "samsung galaxy", "huawei", "xiaomi")),
    ("Elektronik & Multimedia", "Computer & Drucker", (
        "laptop", "notebook", "drucker", "epson", "tintenpatron", "toner", "monitor", "tastatur", "router", "wlan", "festplatte", "ssd ", "usb-stick",
    )),
    ("Elektronik & Multimedia", "TV & Audio", (
        "fernseher", "fernsehgerät", "soundbar", "lautsprecher", "kopfhörer", "kopfhoerer", "bluetooth-box", "blu-ray", "dvd-player", "radio ",
    )),
    ("Elektronik & Multimedia", "Haushaltsgeräte", (
        "staubsauger", "saugroboter", "waschmaschine", "trockner", "geschirrspüler", "geschirrspueler", "fritteuse", "mixer", "toaster", "wasserkocher",
        "kaffeevollautomat", "siebträger", "siebtraeger", "mikrowelle", "backofen", "kühlschrank", "kuehlschrank", "gefrierschrank", "klimaanlage",
    )),
    ("Elektronik & Multimedia", "Sonstige Elektronik", ("ladegerät", "ladegeraet", "powerbank", "akku ", "fernglas", "dartscheibe")),
    ("Mode, Sport & Freizeit", "Sport & Fitness", ("fitness", "yoga", "hantel", "fussball", "fußball", "tennis", "basketball", "trikot", "sportflasche")),
    ("Mode, Sport & Freizeit", "Outdoor", ("outdoor", "wanderschuh", "rucksack", "zelt", "schlafsack", "camping")),
    ("Mode, Sport & Freizeit", "Spielzeug & Hobby", ("fahrrad", "e-bike", "elektrofahrrad", "e-scooter", "scooter", "rollschuh", "skate")),
    ("Mode, Sport & Freizeit", "Kleidung & Schuhe", (
        "kleid ", "hose ", "jacke", "schuh", "schal", "mütze", "muetze", "handschuh", "socken", "t-shirt", "bikini", "bademantel", "fleecedecke",
    )),
    ("Drogerie & Kosmetik", "Parfum & Düfte", ("parfum", "eau de toilette", "eau de parfum")),
    ("Drogerie & Kosmetik", "Gesundheit & Apotheke", (
        "arzneimittel", "vitamin", "augentropfen", "salbe", "verband", "pflaster", "monatshygiene", "tampon", "binde", "magnesium",
    )),
    ("Drogerie & Kosmetik", "Kosmetik & Make-up", ("make-up", "mascara", "lippenstift", "wimperntusche", "lidschatten", "rouge", "nagellack")),
    ("Drogerie & Kosmetik", "Körperpflege", (
        "shampoo", "duschgel", "duschbad", "seife", "bodylotion", "creme", "zahnpasta", "haarspray", "after-shave", "after-sun", "rasierer", "deospray",
        "deoroller",
    )),
    ("Haushalt & Reinigung", "Waschmittel", ("waschmittel", "waschpulver", "weichspüler", "weichspueler", "fleckensalz")),
    ("Haushalt & Reinigung", "Reinigung", ("allzweckreiniger", "wc-reiniger", "glasreiniger", "scheuermilch", "spülmittel", "spuelmittel", "fensterputz")),
    ("Haushalt & Reinigung", "Küchenbedarf", ("geschirr", "besteck", "kochtopf", "pfanne", "auflaufform", "frischhalte", "backblech", "lunchbox")),
    ("Haushalt & Reinigung", "Aufbewahrung", ("aufbewahr", "müllbeutel", "muellbeutel", "abfalleimer", "abfallsack", "mülleimer", "muelleimer")),
    ("Getränke", "Wein & Sekt", ("wein ", "rotwein", "weißwein", "weisswein", "rosé", "sekt", "prosecco", "champagner")),
    ("Getränke", "Bier", ("bier", "pilsener", "pilsner", "weizenbier", "radler", "altbier", "kölsch")),
    ("Getränke", "Spirituosen", ("vodka", "wodka", "gin ", "rum ", "whisky", "whiskey", "likör", "likoer", "tequila")),
    ("Getränke", "Kaffee & Tee", ("kaffee", "espresso", "kapsel", "filterkaffee", "tee ", "kräutertee", "kraeutertee")),
    ("Getränke", "Wasser & Säfte", ("mineralwasser", "wasser ", "saft", "schorle", "limonade", "eistee", "fassbrause")),
    ("Lebensmittel", "Tiefkühl", ("tiefkühl", "tiefkuehl", "tk-pizza", "frosta")),
    ("Lebensmittel", "Fisch", ("lachs", "forelle", "seelachs", "thunfisch", "kabeljau", "fischstäbchen", "fischstaebchen", "garnele", "shrimp")),
    ("Lebensmittel", "Fleisch & Wurst", (
        "fleisch", "salami", "schinken", "wurst", "hähnchen", "haehnchen", "rinder", "schwein", "putenbrust", "hackfleisch", "bratwurst", "leberwurst",
    )),
    ("Lebensmittel", "Milchprodukte & Käse", (
        "mozzarella", "käse", "kaese", "joghurt", "butter ", "milch ", "vollmilch", "h-milch", "sahne ", "quark", "frischkäse", "frischkaese", "emmentaler",
        "gouda", "feta",
    )),
    ("Lebensmittel", "Brot & Backwaren", ("brot ", "brötchen", "broetchen", "baguette", "toast ", "stollen", "lebkuchen", "croissant")),
    ("Lebensmittel", "Süßwaren & Snacks", (
        "schokolade", "praline", "keks ", "bonbon", "chips ", "salzstang", "gummibär", "gummibaer", "müsliriegel", "muesliriegel", "eis ", "eiscreme",
    )),
    ("Lebensmittel", "Obst & Gemüse", (
        "apfel", "banane", "orange", "zitrone", "kirsche", "erdbeere", "tomate", "gurke", "kartoffel", "paprika", "brokkoli", "kohl ", "salat ", "ananas",
        "avocado",
    )),
    ("Lebensmittel", "Grundnahrung & Konserven", (
        "reis ", "nudeln", "pasta", "spaghetti", "mehl ", "zucker", "salz ", "gewürz", "gewuerz", "essig", "öl ", "oel ", "olivenöl", "olivenoel", "ketchup",
        "senf", "müsli", "muesli", "cornflakes", "haferflocken", "honig", "marmelade", "konserve", "antipasti",
    )),
    ("Sonstiges", "Auto & Mobilität", ("autopflege", "autozubehör", "autozubehoer", "scheibenwischer", "winterreifen", "sommerreifen", "motoröl", "motoroel")),
    ("Sonstiges", "Büro & Schreibwaren", (
        "büromaterial", "bueromaterial", "schreibwaren", "kugelschreiber", "ordner ", "aktenschrank", "druckerpapier", "tintenpatron",
    )),
)
#: The same of the category, for titles without a match.
CATEGORY_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Baby & Kind", "Spielzeug", ("baby", "kinder", "fasching")),
    ("Tier", "Katze", ("katze", "katzen")),
    ("Tier", "Hund", ("hund",)),
    ("Tier", "Sonstige Tiere", ("haustier", "vogel")),
    ("Garten & Heimwerken", "Gartenwerkzeug", ("akku-rasenmaeher", "rasenmaeher", "akku-heckenschere", "heckenscher", "akku-kettensaege", "akku-gartenschere")),
    ("Garten & Heimwerken", "Pflanzen & Garten", ("azalee", "apfelbaum", "aster", "blumenkasten", "blumenampel")),
    ("Garten & Heimwerken", "Gartenmöbel", (
        "ampelschirm", "faltpavillon", "feuerschale", "auflagenbox", "abdeckhaube", "abdeckplane", "anzuendkamin", "briketts",
    )),
    ("Garten & Heimwerken", "Werkzeug & Heimwerken", (
        "akkuschrauber", "akku-bohrschrauber", "bohrmaschine", "elektrowerkzeug", "fliesen", "eisenwaren", "alpina", "farbroller",
    )),
    ("Elektronik & Multimedia", "TV & Audio", ("fernsehsessel", "fernseher")),
    ("Elektronik & Multimedia", "Haushaltsgeräte", ("akkustaubsauger", "fritteuse", "allesschneider", "fenstersauger")),
    ("Elektronik & Multimedia", "Sonstige Elektronik", ("akku ", "fernglas", "epson", "ladegeraet", "elektronische-dartscheibe", "funkwanduhr")),
    ("Elektronik & Multimedia", "Smartphone & Tablet", ("apple", "android-tablet")),
    ("Mode, Sport & Freizeit", "Sport & Fitness", ("fitnessgeraete", "fussball")),
    ("Mode, Sport & Freizeit", "Spielzeug & Hobby", ("fahrrad", "elektrofahrrad", "elektrorad")),
    ("Mode, Sport & Freizeit", "Kleidung & Schuhe", ("adidas", "aigner", "aquaschuhe", "arbeitshose", "badetuch", "fleecedecke")),
    ("Drogerie & Kosmetik", "Gesundheit & Apotheke", ("arzneimittel", "augentropfen", "altapharma", "erste-hilfe")),
    ("Drogerie & Kosmetik", "Kosmetik & Make-up", ("essence", "artdeco", "elnett")),
    ("Drogerie & Kosmetik", "Körperpflege", ("aloe-vera", "axe", "always", "einwegrasierer", "fusselrasierer", "after-sun", "after-shave")),
    ("Haushalt & Reinigung", "Waschmittel", ("ariel", "ariel-waschpulver")),
    ("Haushalt & Reinigung", "Reinigung", ("finish", "frosch", "febreze", "ajax", "ecover")),
    ("Haushalt & Reinigung", "Küchenbedarf", ("besteck-set", "auflaufform")),
    ("Haushalt & Reinigung", "Aufbewahrung", (
        "aufbewahrung", "aufbewahrungsbox", "aufbewahrungsdosen", "abfalleimer", "muelleimer", "fussmatte", "bettwaesche",
    )),
    ("Getränke", "Wein & Sekt", (
        "alkoholische-getraenke", "alkoholfreier-sekt", "alkoholfreier-wein", "freixenet-sekt", "metternich", "asti", "cinzano", "fruchtsecco",
    )),
    ("Getränke", "Bier", ("becks", "feldschloesschen", "flensburger-pilsener", "fassbier", "freiberger")),
    ("Getränke", "Spirituosen", ("aperol", "aperitif", "absolut-vodka", "echter-nordhaeuser", "almdudler")),
    ("Getränke", "Kaffee & Tee", ("filterkaffee", "espressobohnen")),
    ("Getränke", "Wasser & Säfte", (
        "alkoholfreie-getraenke", "fanta", "fritz-kola", "afri-cola", "fassbrause", "apfelschorle", "apfelsaft", "orangensaft", "adelholzener",
        "arizona-eistee", "amecke", "appel", "albi", "ayran", "apfelwein",
    )),
    ("Lebensmittel", "Obst & Gemüse", ("apfel", "aprikosen", "avocado", "ananas", "auberginen", "elstar")),
    ("Lebensmittel", "Fisch", ("fisch", "fischstaebchen", "alaska-seelachs", "bio-lachs", "barsch", "forelle")),
    ("Lebensmittel", "Fleisch & Wurst", ("fleisch", "edelsalami", "cordon-bleu", "fleischkaese", "eberswalder", "frikadellen")),
    ("Lebensmittel", "Milchprodukte & Käse", (
        "emmentaler", "appenzeller", "esrom", "alpro", "almighurt", "actimel", "activia", "arla-kaergarden", "almette", "alpenhain", "butter", "mozzarella",
    )),
    ("Lebensmittel", "Brot & Backwaren", ("backwaren", "amerikaner", "apfeltasche")),
    ("Lebensmittel", "Süßwaren & Snacks", ("ferrero", "ferrero-kuesschen", "funny-frisch", "amicelli", "alesto", "eiscreme", "florida-eis", "eclair", "chio")),
    ("Lebensmittel", "Tiefkühl", ("frosta", "tiefkuehl")),
    ("Lebensmittel", "Grundnahrung & Konserven", (
        "antipasti", "alnatura", "ajvar", "anis", "asia", "american-style", "tabasco", "tortilla", "frischer-pasta", "express-reis", "fertiggericht",
        "fruehstueck", "flammkuchen", "frosch", "aspik", "eiersalat", "appel", "apfelringe",
    )),
    ("Sonstiges", "Auto & Mobilität", ("autopflege", "autozubehoer", "autositzbezuege", "auto-sonnenschutz")),
    ("Sonstiges", "Büro & Schreibwaren", ("aktenschrank", "akten")),
)
DEFAULT = ("Sonstiges", "Sonstige")
Rules = Sequence[tuple[str, str, Sequence[str]]]


def taxonomy(spark: SparkSession) -> DataFrame:
    """(bucket, subcategory, ordinal) of every allowed pair."""
    rows = [(b, s) for b, subs in TAXONOMY.items() for s in subs]
    return spark.createDataFrame([(b, s, k) for k, (b, s) in enumerate(rows)], "bucket string, subcategory string, ordinal int")


def is_valid_pair(bucket: Column, subcategory: Column) -> Column:
    pairs = [F.concat_ws("\x1f", F.lit(b), F.lit(s)) for b, subs in TAXONOMY.items() for s in subs]
    return F.coalesce(F.concat_ws("\x1f", bucket, subcategory).isin(*pairs) & bucket.isNotNull() & subcategory.isNotNull(), F.lit(False))


def longest_path(paths: Column) -> tuple[Column, Column]:
    """(top name, "A > B > C") of the longest category path, the first of equals."""
    empty = F.array().cast("array<struct<id:string,name:string>>")
    best = F.aggregate(F.coalesce(paths, F.array().cast("array<array<struct<id:string,name:string>>>")), empty, lambda a, p: F.when(F.coalesce(F.size(p), F.lit(0)) > F.size(a), p).otherwise(a))
    names = F.filter(F.transform(best, lambda n: F.nullif(F.trim(n["name"]), F.lit(""))), lambda n: n.isNotNull())
    return F.get(names, F.lit(0)), F.when(F.size(names) > 0, F.array_join(names, " > "))


def source_bucket(category: Column, path: Column) -> Column:
    """Bucket of a source category, or null where it does not tell."""
    top = F.trim(category)
    level3 = F.coalesce(F.trim(F.get(F.split(path, ">"), F.lit(2))), F.lit(""))
    third = F.coalesce(*[F.when(level3.startswith(p), F.lit(b)) for p, b in SOURCE_LEVEL3])

    def mapped(table: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[top]

    return F.coalesce(mapped(SOURCE_TOP), F.when(mapped(SOURCE_DEFAULT).isNotNull(), F.coalesce(third, mapped(SOURCE_DEFAULT))))


def _keyword(word: str) -> str:
    """A keyword as it stands in padded text: a whole word if it is short, else anywhere."""
    k = re.sub(r"\s+", " ", re.sub("[-_./]", " ", word.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"))).strip()
    return k if len(k) > 4 else f" {k} "


def _first_at(keywords: dict[str, int], depth: int = 0) -> str:
    """A pattern that matches, where some of the keywords begin, the one with the least number."""
    end = min((n for k, n in keywords.items() if len(k) == depth), default=None)
    # whatever goes on after a keyword with a lower number can never be the first one
    longer = {k: n for k, n in keywords.items() if len(k) > depth and (end is None or n < end)}
    nexts: dict[str, dict[str, int]] = {}
    for k, n in longer.items():
        nexts.setdefault(k[depth], {})[k] = n
    branches = [re.escape(c) + _first_at(some, depth + 1) for c, some in nexts.items()] + ([""] if end is not None else [])
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _first_rule(text: Column, rules: Rules) -> Column:
    """The pair of the first rule of which a keyword is in the padded text, or null.

    One pass: at each place a look-ahead gives the keyword of the lowest rule that
    begins there; the lowest rule of all places is the first one.
    """
    number: dict[str, int] = {}
    for k, (_, _, words) in enumerate(rules):
        for w in words:
            number.setdefault(_keyword(w), k)
    if not number:
        return F.lit(None).cast("struct<bucket:string,subcategory:string>")
    found = F.regexp_extract_all(text, F.lit(f"(?=({_first_at(number)}))"), F.lit(1))
    numbers = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])
    pairs = F.array(*[_pair(b, s) for b, s, _ in rules])
    return bind(found, lambda f: F.when(F.size(f) > 0, F.get(pairs, F.array_min(F.transform(f, lambda w: numbers[w])))))


def keyword_rules(rules: DataFrame) -> Rules:
    """Rules of a table (ordinal, bucket, subcategory, keyword) in their order."""
    rows = rules.groupBy("ordinal", "bucket", "subcategory").agg(F.collect_list("keyword").alias("words")).orderBy("ordinal").collect()  # a rule table, not data
    return [(r["bucket"], r["subcategory"], r["words"]) for r in rows]


def _pair(bucket: str, subcategory: str) -> Column:
    return F.struct(F.lit(bucket).alias("bucket"), F.lit(subcategory).alias("subcategory"))


def classify(title: Column, category: Column | None = None, brands: Sequence[tuple[str, str, str]] = BRAND_RULES, titles: Rules = KEYWORD_RULES, categories: Rules = CATEGORY_RULES) -> Column:
    """struct(bucket, subcategory): brands in the title, then title keywords, then category keywords.

    The category is the title where it is null or no category column is given.
    Titles without any brand take one regular expression for brands and one for
    each set of keywords.
    """
    def padded(c: Column) -> Column:
        return F.concat(F.lit(" "), rule_text(c), F.lit(" "))

    def bounded(patterns: Sequence[str]) -> str:
        return rf"(?iu)(?<![A-Za-z0-9_])(?:{'|'.join(patterns)})(?![A-Za-z0-9_])"

    def rules(t: Column) -> Column:
        brand = F.coalesce(*[F.when(t["raw"].rlike(bounded([p])), _pair(b, s)) for b, s, p in brands], F.lit(None)) if brands else F.lit(None)
        hits = [F.when(t["raw"].rlike(bounded([f"(?:{p})" for _, _, p in brands])), brand)] if brands else []
        return F.coalesce(*hits, _first_rule(t["title"], titles), _first_rule(t["category"], categories), _pair(*DEFAULT))

    texts = [F.coalesce(title, F.lit("")).alias("raw"), padded(title).alias("title"), padded(F.coalesce(category, title) if category is not None else title).alias("category")]
    return bind(F.struct(*texts), rules)  # the texts are made once for all rules


def store_class(store: Column) -> Column:
    """supermarket, drugstore or other, by the beginning of the name."""
    name = F.trim(F.coalesce(store, F.lit("")))
    return (
        F.when(name.rlike("(?iu)^(?:" + "|".join(SUPERMARKETS) + ")"), "supermarket")
        .when(name.rlike("(?iu)^(?:" + "|".join(DRUGSTORES) + ")"), "drugstore").otherwise("other")
    )


def sanitize_prefs(df: DataFrame, default_stores: Sequence[str] = (), default_buckets: Sequence[str] = ("Lebensmittel", "Getränke"), default_min: float = 50.0) -> DataFrame:
    """Preference rows with defaults for nulls, only known buckets, and a threshold of 5 to 95 or none.

    Needs user_id, stores, buckets, bargain_min_discount and no_bargains (true: the
    user wants none), onboarded.
    """
    known = F.array_intersect(F.col("buckets"), F.array(*map(F.lit, TAXONOMY)))
    fallback = F.array(*map(F.lit, default_buckets))
    low = F.col("bargain_min_discount")
    return df.select(
        "user_id",
        F.coalesce("stores", F.array(*map(F.lit, default_stores)).cast("array<string>")).alias("stores"),
        F.when(F.size(known) > 0, known).otherwise(fallback).alias("buckets"),
        F.when(F.coalesce("no_bargains", F.lit(False)), F.lit(None)).when(low.between(5, 95), low).otherwise(default_min).cast("double").alias("bargain_min_discount"),
        F.coalesce("onboarded", F.lit(False)).alias("onboarded"),
    )
