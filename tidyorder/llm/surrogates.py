"""Surrogates for personal data, with built-in functions only.

Entities are found by patterns, brought to a canonical form and collected as a table of
distinct entities. Each gets a keyed surrogate of its own kind: digits stay digits in their
layout, cards keep a valid check digit, addresses keep their shape, names keep gender, script
and case. Rounds of checks give a new draw to every surrogate that two entities share or that
is itself an entity of the corpus, so distinct entities stay distinct; equal entities, in any
layout and document, get one surrogate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyorder.llm.common import null_safe_join, stash, text_key

# Forms of address by gender.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
# Parts that names are made of, by script.
SYLLABLES = {
    "latin": "ba den ka lo mi ra so ti ve nu fa gel ho jan ler mar".split(),
    "cyrillic": "ба ва го да же за ки ло ми но па ра са ту фе ше".split(),
    "greek": "βα γε δι ζω θα κι λα μα νι ξε πα ρω σα τι φα χρι".split(),
}
ENDINGS = {
    "latin": {"given_m": ["o", "an", "ek", "us"], "given_f": ["a", "ia", "ine", "elle"], "given_n": ["i", "ey", "is", "on"], "surname": ["sen", "berg", "ling", "mont"]},
    "cyrillic": {"given_m": ["н", "р", "слав", "мир"], "given_f": ["на", "ра", "слава", "мира"], "given_n": ["я", "и", "ис", "ин"], "surname": ["енко", "ич", "юк", "ых"]},
    "greek": {"given_m": ["ος", "ης", "ας", "ων"], "given_f": ["α", "η", "ια", "ω"], "given_n": ["ις", "ω", "ι", "ους"], "surname": ["ίδη", "ου", "άκη", "έα"]},
}
ALPHABETS = {"[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_TITLE = "|".join(t for ts in TITLES.values() for t in dict.fromkeys([*ts, *[x.upper() for x in ts]]))
# A word of a name; repeats of groups are bounded, since Java matches them by recursion.
_WORD = r"\p{Lu}\p{L}*+(?:['’-]\p{Lu}\p{L}*+){0,4}"
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,126}\.\p{L}{2,}",
    _EDGE + r"[0-9a-fA-F]{32,64}" + _END,
    r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)",
    _EDGE + r"\d{13,19}" + _END,
    _EDGE + r"\+?(?:\d|\(\d{2,4}\))(?:[ .()-]{0,2}\d){7,18}" + _END,
    _EDGE + rf"(?:{_TITLE})\.?(?: (?:\p{{Lu}}\.|{_WORD})){{1,12}}",
])
#: For documents with a title: a capitalised word may also repeat a name found elsewhere in them.
NAMED = PATTERN + "|" + _EDGE + _WORD + _END
TITLED = _EDGE + rf"(?:{_TITLE})\.? \p{{Lu}}"
#: A document without a match of this has no entity.
HINT = rf"[0-9@]|(?:{_TITLE})\.? "


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Check sum of the digit string d, the last digit being the check digit."""
    step = f"cast(substr({d}, length({d}) - i, 1) as int) * (1 + i % 2)"
    return f"aggregate(transform(sequence(0, length({d}) - 1), i -> {step}), 0, (s, v) -> s + if(v > 9, v - 9, v))"


_KIND = f"""CASE
  WHEN m LIKE '%@%' THEN 'email'
  WHEN m RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN if(forall(split(m, '[.]'), o -> cast(o as int) <= 255), 'ip', 'none')
  WHEN m RLIKE '^[0-9a-fA-F]{{32,}}$' THEN 'token'
  WHEN m RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
  WHEN m RLIKE '^[0-9 -]+$' AND length(d) BETWEEN 13 AND 19 AND ({_luhn("d")}) % 10 = 0 THEN 'card'
  WHEN (m RLIKE '[+() -]' OR m RLIKE '^[0-9]{{1,4}}([.][0-9]{{2,4}}){{2,4}}$') AND m RLIKE '^[0-9+() .-]+$' AND length(d) BETWEEN 9 AND 15 THEN 'phone'
  WHEN m RLIKE '^[0-9+() .-]+$' THEN 'none'
  WHEN m RLIKE {_sql(f"^(?:{_TITLE})[.]? ")} THEN 'person'
  ELSE 'bare' END"""


def _drawn(x: str, hexed: str, classes: dict[str, str]) -> str:
    """x with every character of a class replaced by one of its alphabet, chosen by hex digits."""
    cases = " ".join(
        f"WHEN substr({x}, i, 1) RLIKE {_sql(c)} THEN substr({_sql(a)}, 1 + cast(conv(substr({hexed}, 1 + (3 * i) % 250, 3), 16, 10) as int) % {len(a)}, 1)"
        for c, a in classes.items()
    )
    return f"if(length({x}) = 0, '', array_join(transform(sequence(1, length({x})), i -> CASE {cases} ELSE substr({x}, i, 1) END), ''))"


def _pick(values: list[str], hexed: str, at: int | str) -> str:
    listed = ", ".join(_sql(v) for v in values)
    return f"element_at(array({listed}), 1 + cast(conv(substr({hexed}, {at}, 4), 16, 10) as int) % {len(values)})"


def _name(kind: str) -> str:
    by_script = []
    for script, syllables in SYLLABLES.items():
        parts = [_pick(syllables, "h", 1), _pick(syllables, "h", 9), f"if(attempt > 2, {_pick(syllables, 'h', 17)}, '')", f"if(attempt > 6, {_pick(syllables, 'h', 25)}, '')"]
        # from then on a syllable more at each attempt, so that there are more names than entities
        parts.append(f"if(attempt > 7, array_join(transform(sequence(1, attempt - 7), j -> {_pick(syllables, 'h', '41 + (4 * (j - 1)) % 212')}), ''), '')")
        parts.append(_pick(ENDINGS[script][kind], "h", 33))
        test = {"latin": "true", "cyrillic": r"canon RLIKE '\\p{IsCyrillic}'", "greek": r"canon RLIKE '\\p{IsGreek}'"}[script]
        by_script.append((test, f"concat({', '.join(parts)})"))
    by_script.sort(key=lambda x: x[0] == "true")
    return "CASE " + " ".join(f"WHEN {t} THEN {e}" for t, e in by_script) + " END"


def _with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """Adds s, the surrogate of (kind, canon) at its attempt; email domains are drawn by domain."""
    digest = lambda *parts: F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(k)), *parts), 256) for k in range(4)])
    rows = entities.withColumn("h", digest("kind", "canon", F.col("attempt").cast("string")))
    rows = rows.withColumn("hd", digest(F.lit("domain"), F.expr("substring_index(canon, '@', -1)")))
    rows = rows.withColumns({"local": F.expr("substring_index(canon, '@', 1)"), "host": F.expr("regexp_extract(canon, '@(.*)[.][^.]*$', 1)"), "tld": F.expr("regexp_extract(canon, '[.][^.]*$', 0)")})
    any_digit = _drawn("canon", "h", {"[0-9]": ALPHABETS["[0-9]"]})
    rows = rows.withColumn("body", F.expr("if(kind = 'card', concat(substr(canon, 1, 1), substr(" + any_digit + ", 2, length(canon) - 2), '0'), '')"))
    longer = "if(attempt > 6, substr(h, 200, attempt - 6), '')"
    octets = ", '.', ".join(f"cast(1 + cast(conv(substr(h, {1 + 4 * k}, 4), 16, 10) as int) % 254 as string)" for k in range(4))
    s = f"""CASE kind
      WHEN 'email' THEN concat({_drawn("local", "h", ALPHABETS)}, {longer}, '@', {_drawn("host", "hd", ALPHABETS)}, tld)
      WHEN 'ip' THEN concat({octets})
      WHEN 'token' THEN substr(h, 1, length(canon))
      WHEN 'card' THEN concat(substr(body, 1, length(body) - 1), cast((10 - ({_luhn("body")}) % 10) % 10 as string))
      WHEN 'given_m' THEN {_name("given_m")} WHEN 'given_f' THEN {_name("given_f")} WHEN 'given_n' THEN {_name("given_n")} WHEN 'surname' THEN {_name("surname")}
      ELSE concat(if(canon LIKE '0%', '0', cast(1 + cast(conv(substr(h, 240, 4), 16, 10) as int) % 9 as string)), substr({any_digit}, 2)) END"""
    return rows.withColumn("s", F.expr(s)).select(*entities.columns, "s")


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, s for distinct entities (kind, canon). No two entities of a kind share a
    surrogate and none is an entity; of those that clash the earliest drawn stays, the smallest
    first, and the others draw again."""
    state = stash(_with_surrogate(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = entities.select("kind", F.col("canon").alias("s"), F.lit(True).alias("real"))
    while True:
        first = state.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        judged = state.join(first, ["kind", "s"]).join(real, ["kind", "s"], "left")
        clash = F.col("real").isNotNull() | (F.col("first.canon") != F.col("canon"))
        judged = stash(judged.select("kind", "canon", "attempt", "s", clash.alias("clash")), "surrogates")
        if judged.filter("clash").isEmpty():
            return judged.select("kind", "canon", "s")
        again = _with_surrogate(judged.filter("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), key)
        state = stash(judged.filter("not clash").select("kind", "canon", "attempt", "s").unionByName(again), "surrogates")


def _parts() -> Column:
    """Parts of a match: kind, canonical form, surface. A name has one part per word; titles and
    initials stay."""
    gender = F.lit("given_m")
    for g in ("f", "n"):
        gender = F.when(F.col("m").rlike(rf"^(?i:{'|'.join(TITLES[g])})\.? "), f"given_{g}").otherwise(gender)
    words = F.split("m", " ")
    kind = lambda w, i: F.when((i == 0) | w.endswith("."), "none").when(i == F.size(words) - 1, "surname").otherwise(gender)
    name = F.transform(words, lambda w, i: F.struct(kind(w, i).alias("kind"), F.lower(w).alias("canon"), w.alias("surface")))
    canon = F.expr("CASE kind WHEN 'phone' THEN if(length(d) > 10, right(d, 10), d) WHEN 'card' THEN d WHEN 'ssn' THEN d ELSE lower(m) END")
    return F.when(F.col("kind") == "person", name).otherwise(F.array(F.struct(F.col("kind"), canon.alias("canon"), F.col("m").alias("surface"))))


def _rendered() -> str:
    """The surrogate s in the layout of the surface: digits in place, capitals like before."""
    digits = "concat(left(sd, length(sd) - length(s)), s)"
    laid = f"array_join(transform(sequence(1, length(surface)), i -> if(substr(surface, i, 1) RLIKE '[0-9]', substr(filled, length({_digits('substr(surface, 1, i)')}), 1), substr(surface, i, 1))), '')"
    return f"""CASE WHEN s IS NULL THEN surface
      WHEN kind IN ('phone', 'card', 'ssn') THEN {laid.replace("filled", digits)}
      WHEN upper(surface) = surface AND lower(surface) <> surface THEN upper(s)
      WHEN kind IN ('given_m', 'given_f', 'given_n', 'surname') THEN initcap(s)
      ELSE s END"""


def replace_private(docs: DataFrame, key: str = "surrogate-key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tk, n_entities, kinds, text with surrogates.

    Kinds: email, ip, token, ssn, card (valid check digit), phone, given_m, given_f, given_n
    (gender unknown) and surname (after a form of address, which stays, and wherever the document
    repeats the word with a capital). Null text stays null and has no entities; equal
    rows get equal results; other columns are left out. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tk"), F.col(text_col).alias("text"))
    titled = F.col("text").rlike(TITLED)
    matches = F.when(titled, F.regexp_extract_all("text", F.lit(NAMED), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = rows.filter(F.col("text").rlike(HINT)).withColumn("ms", matches)
    found = found.select("doc_id", "tk", F.posexplode("ms").alias("at", "m")).withColumn("d", F.expr(_digits("m"))).withColumn("kind", F.expr(_KIND))
    parts = stash(found.select("doc_id", "tk", "at", F.posexplode(_parts()).alias("sub", "part")).select("doc_id", "tk", "at", "sub", "part.*"), "private-parts")
    # a bare word is a name where its document has that name after a title
    names = parts.filter(F.col("kind").isin("given_m", "given_f", "given_n", "surname")).groupBy("doc_id", "tk", "canon").agg(F.min("kind").alias("known"))
    bare = null_safe_join(parts.filter("kind = 'bare'"), names, ["doc_id", "tk", "canon"], "left").withColumn("kind", F.coalesce("known", F.lit("none"))).drop("known")
    parts = parts.filter("kind <> 'bare'").unionByName(bare)
    entities = stash(parts.filter("kind <> 'none'").select("kind", "canon").distinct(), "private-entities")
    named = surrogate_table(entities, key)
    placed = parts.join(named, ["kind", "canon"], "left").withColumn("sd", F.expr(_digits("surface"))).withColumn("new", F.expr(_rendered()))
    # equal rows meet here; the parts of a match, then the matches of a text, in their order
    match = placed.groupBy("doc_id", "tk", "at").agg(F.sort_array(F.collect_set(F.struct("sub", "new", "kind"))).alias("ps"))
    match = match.select("doc_id", "tk", F.struct("at", F.array_join("ps.new", " ").alias("new"), F.col("ps.kind").alias("kinds")).alias("item"))
    by_doc = match.groupBy(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    # columns of their own: a field taken inside the function below would be copied for each match
    by_doc = by_doc.select("__id", "__tk", F.col("items.new").alias("news"), F.flatten("items.kinds").alias("kinds"))
    joined = rows.join(by_doc, rows["doc_id"].eqNullSafe(by_doc["__id"]) & (rows["tk"] == by_doc["__tk"]), "left")
    # pieces between matches, with the new text of each match after its piece
    pieces = F.when(titled, F.split("text", NAMED, -1)).otherwise(F.split("text", PATTERN, -1))
    text = F.array_join(F.transform("pieces", lambda p, i: F.concat(p, F.coalesce(F.get("news", i), F.lit("")))), "")
    done = joined.withColumn("pieces", F.when(F.col("news").isNotNull(), pieces))
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    real = F.filter(kinds, lambda k: k != "none")
    return done.select(
        "doc_id", "tk", F.size(real).cast("long").alias("n_entities"), F.array_sort(F.array_distinct(real)).alias("kinds"),
        F.when(F.col("news").isNull(), F.col("text")).otherwise(text).alias("text"),
    )
