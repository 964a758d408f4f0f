"""Spellings of one person or organisation, linked.

Method: merge-and-rematch resolution. Each distinct spelling is parsed into a profile (a person: given names, further
initials, surnames; an organisation: proper name and kind). Profiles with the same key merge at once. Then, in rounds,
profiles meet in blocks, matched ones merge, the merged profile unites spellings and initials, and the richer profiles
enter blocking again, until a round merges nothing.

Blocks are made of one whole name part and the deletion variants of the other, so that spellings one edit apart meet
without comparing all names of a block; identical spellings are one row whatever their number. A name part one
edit away from another is a typing error of it; two parts that are both well attested are two names. An initial joins the only profile that it
can stand for, by its further initials if need be, and none if several remain.

Defined results: null and blank names give no row; a name equal to another but for case, accents, titles, order, legal form
or department is linked; spellings that occur once only are compared like others.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.sources.tables import table

#: One edit apart, a name part is a typing error of another, unless both are written in several ways (with titles,
#: accents, in other order …) as real names are, and the rarer has more rows than RARE and than this share of the other's.
TYPO_SHARE, RARE = 0.2, 2
#: A word is a given name if it stands first so often, and mostly first.
GIVEN = 5

# Short forms of given names and what they stand for.
NICKNAMES = {
    "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "joey": "joseph", "tom": "thomas", "tommy": "thomas",
    "nick": "nicholas", "mike": "michael", "mick": "michael", "susi": "susanne", "sue": "susanne", "susie": "susanne",
    "rick": "richard", "dick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert",
    "bill": "william", "will": "william", "billy": "william", "beppe": "giuseppe", "peppe": "giuseppe", "peggy": "margaret",
    "maggie": "margaret", "meg": "margaret", "chris": "christopher", "kit": "christopher", "sasha": "alexander",
    "alex": "alexander", "sandy": "alexander", "trish": "patricia", "pat": "patricia", "patty": "patricia",
    "tricia": "patricia", "sam": "samuel", "sammy": "samuel", "ed": "edward", "eddie": "edward", "ned": "edward",
    "ted": "edward theodore", "teddy": "edward theodore", "theo": "theodore", "paco": "francisco", "pancho": "francisco",
    "kiko": "francisco", "beth": "elizabeth", "liz": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth",
    "eliza": "elizabeth", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine",
    "andy": "andrew", "drew": "andrew", "ben": "benjamin", "benny": "benjamin", "dan": "daniel", "danny": "daniel",
    "hans": "johannes", "hannes": "johannes", "jo": "johannes", "jim": "james", "jimmy": "james", "steve": "stephen",
    "dave": "david", "matt": "matthew", "greg": "gregory", "fred": "frederick", "tony": "anthony", "charlie": "charles",
    "harry": "henry", "jack": "john", "johnny": "john", "larry": "lawrence", "becky": "rebecca", "cathy": "catherine",
    "debbie": "deborah", "vicky": "victoria", "pepe": "jose", "lola": "dolores", "gigi": "luigi", "toni": "anton",
}
_TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "ing", "dipl", "phd", "md", "msc", "bsc", "mba", "jr", "sr", "ii", "iii", "dphil", "habil"}
# Legal forms, words of departments, abbreviations and kinds of organisations.
_LEGAL = {"gmbh", "inc", "incorporated", "ltd", "limited", "plc", "llp", "llc", "ag", "corp", "corporation", "co", "company", "sa", "sas", "srl", "spa", "bv", "nv", "se", "kg", "oy", "ab", "as", "pty"}
_SMALL = {"the", "of", "for", "and", "de", "der", "des", "la", "du", "in", "und", "et", "y"}
_UNIT = re.compile(r"^(?:dept|department|faculty|school|division|chair|section|unit|group|college|centre|center|institute)\b\.?\s+(?:of|for)\b")
_SHORT = {
    "univ": "university", "universitat": "university", "universite": "university", "universidad": "university", "inst": "institute",
    "tech": "technology", "fdn": "foundation", "found": "foundation", "fndn": "foundation", "vent": "ventures", "venture": "ventures",
    "hldgs": "holdings", "hldg": "holdings", "holding": "holdings", "res": "research", "ctr": "centre", "center": "centre", "cent": "centre",
    "distr": "distributed", "dist": "distributed", "sys": "systems", "syst": "systems", "system": "systems", "lab": "laboratory",
    "labs": "laboratory", "laboratories": "laboratory", "ptrs": "partners", "ptnrs": "partners", "partner": "partners", "cap": "capital",
    "nat": "national", "natl": "national", "dig": "digital", "ast": "asset", "assets": "asset", "fd": "fund", "funds": "fund", "en": "energy",
    "enrg": "energy", "intl": "international", "assoc": "association", "acad": "academy", "min": "ministry", "agcy": "agency", "grp": "group",
}
KINDS = set(
    "university technical institute technology foundation ventures laboratory holdings capital partners digital asset fund energy systems "
    "research centre distributed national college school hospital agency ministry bank group association society council academy trust "
    "network consortium international".split()
)


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def parse_person(raw: str) -> tuple[list[str], list[str], bool]:
    """(full parts, initials, whether the order given-surname is sure) of a person's name."""
    parts = [[w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", fold(p)) if w not in _TITLES] for p in raw.split(",")]
    parts = [p for p in parts if p]
    sure = len(parts) > 1
    words = [w for p in (parts[1:] + parts[:1]) for w in p]
    if not sure:
        shown = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", raw) if fold(w) not in _TITLES and len(w) > 1]
        if len(shown) == 2 and len(words) == 2 and shown[0].isupper() and not shown[1].isupper() and len(shown[0]) > 2:
            words, sure = words[::-1], True  # SURNAME Given
    return [w for w in words if len(w) > 1], [w for w in words if len(w) == 1], sure


def near_word(word: str, words: set[str]) -> str | None:
    """The word of words that word is, or from which it is one edit away; short words must be equal."""
    if word in words:
        return word
    if len(word) < 6:
        return None
    return next((w for w in sorted(words) if len(w) > 5 and w[0] == word[0] and one_edit(word, w)), None)


def parse_organisation(raw: str) -> tuple[str, str]:
    """(proper name, kind) of an organisation's name, without department, place, legal form, acronym and site."""
    text = fold(raw)
    text = re.sub(r"\s*\([^)]*\)\s*$", "", text)
    text = re.sub(r"\s+[-–]\s+(?:hq|headquarters|main campus|main office|[a-z]+ (?:campus|office|branch))\s*$", "", text)
    pieces = [p.strip() for p in text.split(",") if p.strip()]
    if len(pieces) > 1 and _UNIT.match(pieces[0]):
        pieces = pieces[1:]
    named = [[_SHORT.get(w, w) for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", p)] for p in pieces]
    kind_words = [[near_word(w, KINDS) for w in p] for p in named]
    if len(named) > 1 and any(kind_words[0]) and not any(kind_words[-1]) and len([w for w, k in zip(named[0], kind_words[0]) if not k and w not in _SMALL | _LEGAL]):
        named, kind_words = named[:1], kind_words[:1]  # the rest is a place or a legal form
    proper, kind = [], set()
    for words, kinds in zip(named, kind_words):
        for w, k in zip(words, kinds):
            if k:
                kind.add(k)
            elif w not in _SMALL and w not in _LEGAL:
                proper.append(w)
    if "university" in kind and "technology" in kind and "institute" not in kind:
        kind = (kind - {"technology"}) | {"technical"}  # "Tech Univ" is read as its full form
    if not proper:
        proper, kind = [w for p in named for w in p], set()
    return " ".join(proper), " ".join(sorted(kind))


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by at most one inserted, dropped or replaced letter or one swap of neighbours."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])


@F.pandas_udf(T.BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.StructType([T.StructField("full", T.ArrayType(T.StringType())), T.StructField("initials", T.ArrayType(T.StringType())), T.StructField("sure", T.BooleanType())]))
def _person(names: pd.Series) -> pd.DataFrame:
    rows = [parse_person(n) for n in names]
    return pd.DataFrame({"full": [r[0] for r in rows], "initials": [r[1] for r in rows], "sure": [r[2] for r in rows]})


@F.pandas_udf(T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())]))
def _organisation(names: pd.Series) -> pd.DataFrame:
    rows = [parse_organisation(n) for n in names]
    return pd.DataFrame({"x": [r[0] for r in rows], "y": [r[1] for r in rows]})


def _deletions(word: Column) -> Column:
    """word and what is left of it when one letter is dropped; two words one edit apart share one of these."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def persons(spellings: DataFrame) -> DataFrame:
    """(name, n, x, y, middle, initial) of spellings (name, n): x given name or initial, y surname, initial whether x is one."""
    p = session.cut(spellings.withColumn("p", _person("name")).select("name", "n", "p.*").where(F.size("full") > 0))
    two = p.where((F.size("full") == 2) & ~F.col("sure"))
    places = two.select(F.explode(F.array(F.struct(F.element_at("full", 1).alias("w"), F.lit(1).alias("first")), F.struct(F.element_at("full", 2).alias("w"), F.lit(0).alias("first")))).alias("e")).select("e.*")
    score = places.groupBy("w").agg(F.sum(2 * F.col("first") - 1).alias("score"))
    a, b = score.withColumnsRenamed({"w": "a", "score": "sa"}), score.withColumnsRenamed({"w": "b", "score": "sb"})
    p = p.withColumns({"a": F.element_at("full", 1), "b": F.element_at("full", -1)}).join(a, "a", "left").join(b, "b", "left")
    # A lone first part that mostly stands last, before one that mostly stands first, is a surname written first.
    swap = ~F.col("sure") & (F.size("full") == 2) & (F.coalesce("sb", F.lit(0)) > F.coalesce("sa", F.lit(0)))
    alone = F.size("full") == 1
    x = F.when(alone, F.coalesce(F.get("initials", F.lit(0)), F.lit(""))).when(swap, F.col("b")).otherwise(F.col("a"))
    y = F.when(alone, F.col("a")).when(swap, F.col("a")).otherwise(F.col("b"))
    rest = F.when(alone, F.slice("initials", F.lit(2), F.greatest(F.size("initials") - 1, F.lit(0)))).otherwise(F.concat("initials", F.transform(F.slice("full", 2, F.greatest(F.size("full") - 2, F.lit(0))), lambda w: F.substring(w, 1, 1))))
    known = F.when(alone, False).otherwise(F.coalesce(F.when(swap, F.col("sb")).otherwise(F.col("sa")), F.lit(0)) >= GIVEN)
    return p.select("name", "n", x.alias("x"), y.alias("y"), rest.alias("middle"), alone.alias("initial"), known.alias("known")).where(F.col("x") != "")


def _formal(x: Column) -> Column:
    """The full form of a given name, if a short form stands for just one."""
    single = F.create_map(*[F.lit(v) for k, f in NICKNAMES.items() if " " not in f for v in (k, f)])
    return F.coalesce(F.try_element_at(single, x), x)


def _merge(member: DataFrame, edges: DataFrame) -> DataFrame:
    """member (name, entity, …) after each entity took the smallest entity that an edge (a, b) joins it to, and that one's own;
    ``fresh`` tells whose entity has changed by that."""
    both = edges.select(F.col("a").alias("entity"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("entity"), F.col("a").alias("to")))
    best = both.groupBy("entity").agg(F.min("to").alias("to")).withColumn("to", F.least("entity", "to"))
    # Labels go two steps a round, so that long chains of spellings take few rounds.
    best = best.join(best.select(F.col("entity").alias("to"), F.col("to").alias("further")), "to", "left").select("entity", F.coalesce("further", "to").alias("to"))
    kept = member.drop("fresh").join(best, "entity", "left").withColumn("fresh", F.col("to").isNotNull())
    return kept.withColumn("entity", F.coalesce("to", "entity")).drop("to")


def _rounds(member: DataFrame, edges_of) -> DataFrame:
    """Merges and matches again until a round finds no edge; each round merges two entities at least, so it ends."""
    with session.plain(member.sparkSession):
        member = session.cut(member.withColumn("fresh", F.lit(True)))
        while True:
            edges = session.cut(edges_of(member).select("a", "b").distinct())
            if edges.isEmpty():
                return member.drop("fresh")
            member = session.cut(_merge(member, edges))


def _typing_errors(profile: DataFrame, whole: str, edited: str) -> DataFrame:
    """Edges (a, b) of profiles (entity, x, y, n, ways, known, fresh) that share the part whole, their other part being one edit
    apart. Two profiles that were compared before and have not changed since are not compared again."""
    keys = profile.select("entity", "n", "ways", "known", "fresh", F.col(whole).alias("w"), F.col(edited).alias("e"), F.explode(_deletions(F.col(edited))).alias("d")).where(F.length("e") > 3)
    other = keys.select("w", "d", F.col("entity").alias("b"), F.col("n").alias("m"), F.col("ways").alias("ways_b"), F.col("e").alias("f"), F.col("known").alias("known_b"), (~F.col("fresh")).alias("old"))
    # The first side has changed; of two changed ones, one order is enough.
    pairs = keys.where("fresh").withColumnRenamed("entity", "a").drop("fresh").join(other, ["w", "d"]).where((F.col("a") < F.col("b")) | (F.col("old") & (F.col("a") != F.col("b"))))
    low, high = F.least("n", "m"), F.greatest("n", "m")
    pairs = pairs.where((F.least("ways", "ways_b") < 2) | (low <= RARE) | (low <= TYPO_SHARE * high))
    if edited == "x":  # two given names in use are two names
        pairs = pairs.where(~(F.col("known") & F.col("known_b")) | (F.col("e") == F.col("f")))
    pairs = pairs.select("a", "b", "e", "f").distinct()
    return pairs.where(_one_edit("e", "f")).select("a", "b")


def _person_edges(member: DataFrame) -> DataFrame:
    spelt = member.where(~F.col("initial"))
    # Written once: each of the plans below would else hold all that makes a profile, and the driver keeps every plan.
    profile = session.cut(spelt.groupBy("entity", "x", "y").agg(F.sum("n").alias("n"), F.count("*").alias("ways"), F.max("known").alias("known"), F.max("fresh").alias("fresh")))
    edges = _typing_errors(profile, "x", "y").unionByName(_typing_errors(profile, "y", "x"))
    same = profile.groupBy("x", "y").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a < b").select("a", "b")
    # A short form of several names stands for the one that the surname has.
    several = [(k, f) for k, fs in NICKNAMES.items() if " " in fs for f in fs.split()]
    forms = member.sparkSession.createDataFrame(several, "x string, formal string")
    short = profile.join(F.broadcast(forms), "x").select(F.col("entity").alias("a"), "y", F.col("formal").alias("x"))
    hits = short.join(profile.select("x", "y", F.col("entity").alias("b")), ["x", "y"]).where("a <> b").select("a", "b").distinct()
    hits = hits.groupBy("a").agg(F.count_distinct("b").alias("c"), F.min("b").alias("b")).where("c = 1").select("a", "b")
    return edges.unionByName(same).unionByName(hits).unionByName(_initial_edges(member, spelt))


def _initial_edges(member: DataFrame, spelt: DataFrame) -> DataFrame:
    """An initial with a surname joins the one profile that it can stand for."""
    firsts = F.array_distinct(F.array(F.substring("x", 1, 1), F.substring("given", 1, 1)))
    full = session.cut(spelt.select("entity", "y", F.explode(firsts).alias("i"), "middle").groupBy("entity", "y", "i").agg(F.array_distinct(F.flatten(F.collect_set("middle"))).alias("has")))
    short = member.where("initial").select(F.col("entity").alias("a"), "y", F.col("x").alias("i"), "middle").distinct()
    exact = short.join(full, ["y", "i"]).where(F.col("a") != F.col("entity"))
    # A surname that no such profile has may be mistyped.
    lost = short.join(full.select("y", "i").distinct(), ["y", "i"], "left_anti")
    typed = lost.select("*", F.explode(_deletions(F.col("y"))).alias("d")).withColumnRenamed("y", "z")
    typed = typed.join(full.select("*", F.explode(_deletions(F.col("y"))).alias("d")), ["d", "i"]).where((F.col("a") != F.col("entity")) & (F.length("z") > 4)).drop("d").distinct()
    typed = typed.where(_one_edit("z", "y")).drop("z")
    hits = exact.select("a", "entity", "middle", "has").unionByName(typed.select("a", "entity", "middle", "has"))
    asked = F.size("middle") > 0
    fits = asked & F.arrays_overlap("middle", "has")
    clash = asked & (F.size("has") > 0) & ~F.arrays_overlap("middle", "has")
    seen = hits.where(~clash).groupBy("a", "entity").agg(F.max(fits).alias("fits"))
    ranked = seen.groupBy("a").agg(F.count("*").alias("all"), F.count_if("fits").alias("fit"), F.min("entity").alias("one"), F.min(F.when(F.col("fits"), F.col("entity"))).alias("fitting"))
    only = F.when(F.col("fit") == 1, F.col("fitting")).when(F.col("all") == 1, F.col("one"))
    return ranked.select("a", only.alias("b")).where(F.col("b").isNotNull())


def resolve_persons(spellings: DataFrame) -> DataFrame:
    """(name, entity) of spellings (name, n)."""
    rows = persons(spellings).withColumn("given", F.col("x"))
    rows = rows.withColumn("x", F.when(F.col("initial"), F.col("x")).otherwise(_formal(F.col("x"))))
    # A middle initial tells apart what an initial alone cannot.
    key = F.when(F.col("initial"), F.concat_ws("|", F.lit("~"), "x", F.concat_ws("", "middle"), "y")).otherwise(F.concat_ws("|", "x", "y"))
    done = _rounds(rows.withColumn("entity", key), _person_edges)
    # Initials that several profiles could stand for name nobody for sure.
    firsts = F.explode(F.array_distinct(F.array(F.substring("x", 1, 1), F.substring("given", 1, 1)))).alias("x")
    meant = done.where(~F.col("initial")).select("entity", "y", firsts).distinct().groupBy("x", "y").count().where("count > 1").select("x", "y")
    unclear = done.where(F.col("initial") & F.col("entity").startswith("~")).join(meant, ["x", "y"], "left_semi").select("name")
    return done.join(unclear, "name", "left_anti").select("name", "entity")


def _organisation_edges(member: DataFrame) -> DataFrame:
    profile = member.groupBy("entity", "x", "y").agg(F.sum("n").alias("n"), F.count("*").alias("ways"), F.max("fresh").alias("fresh"))
    profile = session.cut(profile.withColumn("known", F.lit(False)))
    same = profile.groupBy("x", "y").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a < b").select("a", "b")
    return _typing_errors(profile, "y", "x").unionByName(same)


def resolve_organisations(spellings: DataFrame) -> DataFrame:
    """(name, entity) of spellings (name, n)."""
    rows = spellings.withColumn("o", _organisation("name")).select("name", "n", "o.*").where(F.col("x") != "")
    return _rounds(rows.withColumn("entity", F.concat_ws("|", "x", "y")), _organisation_edges).select("name", "entity")


def _spellings(df: DataFrame) -> DataFrame:
    return session.cut(df.where(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n")))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, name, entity): every spelling with its entity."""
    person = _spellings(table(spark, folder, "expert_data", F.col("expert_name").alias("name")))
    organisation = _spellings(
        table(spark, folder, "expert_data", F.col("affiliation").alias("name")).unionByName(table(spark, folder, "investment_data", F.col("investor_or_organization").alias("name")))
    )
    return resolve_persons(person).withColumn("kind", F.lit("person")).unionByName(resolve_organisations(organisation).withColumn("kind", F.lit("organisation")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of different spellings of one entity."""
    rows = session.cut(entities(spark, folder))
    other = rows.select("kind", "entity", F.col("name").alias("name_b"))
    return rows.withColumnRenamed("name", "name_a").join(other, ["kind", "entity"]).where(F.col("name_a") < F.col("name_b")).select("kind", "name_a", "name_b").distinct()


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind: entities by their number of spellings."""
    sizes = entities(spark, folder).groupBy("kind", "entity").agg(F.count("*").alias("spellings"))
    return sizes.groupBy("kind", "spellings").agg(F.count("*").alias("entities"))
