"""De-identification by rules on elements.

A rule names a tag and what happens to it at any depth: remove, replace (with a text), remap (a UI value becomes a
stable 2.25 identifier; anything else is removed) or keep. Removing or replacing a sequence takes its items along.
The stable identifiers are plain hashes, not secrets. File meta information is elements like others: apply the rules to
it as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import values
from lumenframe.model import TAG
from lumenframe.operators.lookup import small

# Direct identifiers that the basic profile of PS3.15 removes, replaces or remaps.
REMOVED = "PatientBirthDate PatientBirthTime OtherPatientIDs OtherPatientNames PatientAddress PatientTelephoneNumbers AccessionNumber InstitutionName ReferringPhysicianName PhysiciansOfRecord PerformingPhysicianName NameOfPhysiciansReadingStudy OperatorsName RequestingPhysician AdmissionID ScheduledPerformingPhysicianName".split()
REPLACED = "PatientName PatientID".split()
REMAPPED = "StudyInstanceUID SeriesInstanceUID SOPInstanceUID ReferencedSOPInstanceUID MediaStorageSOPInstanceUID".split()


def basic_profile(spark: SparkSession, replacement: str = "Anonymous") -> DataFrame:
    """(tag, action, replacement) of the basic profile."""
    rows = [(TAG[n], "remove", None) for n in REMOVED] + [(TAG[n], "replace", replacement) for n in REPLACED] + [(TAG[n], "remap", None) for n in REMAPPED]
    return spark.createDataFrame(rows, "tag long, action string, replacement string")


#: Rules and requirements are lists that people write; a longer table is a mistake and not collected.
LONGEST_LIST = 100_000


def listed(rows: DataFrame) -> list:
    """The rows of a caller's list, of bounded length."""
    own = rows.limit(LONGEST_LIST + 1).collect()
    if len(own) > LONGEST_LIST:
        raise ValueError(f"more than {LONGEST_LIST} rules")
    return own


def apply_to_files(decoded: DataFrame, rules: DataFrame, remove_private: bool = True) -> DataFrame:
    """Decoded files with the rules applied to their arrays of elements: no shuffle, no row an element.

    The same rules and results as apply_rules.
    """
    acts = {r["tag"]: (r["action"], r["replacement"]) for r in listed(rules.where("action <> 'keep'").select("tag", "action", "replacement"))}
    odd = lambda tag: F.shiftright(tag, 16) % 2 == 1
    by = {a: sorted(t for t, (act, _) in acts.items() if act == a) for a in ("remove", "replace", "remap")}
    named = lambda e, a: e["tag"].isin(by[a]) if by[a] else F.lit(False)
    remappable = lambda e: (e["vr"] == "UI") & e["item_count"].isNull() & (F.coalesce(values.text(e["value"]), F.lit("")) != "")

    def stays(e):
        cut = F.exists(e["path"], lambda p: p["tag"].isin(sorted(acts))) if acts else F.lit(False)
        if remove_private:
            cut = cut | odd(e["tag"]) | F.exists(e["path"], lambda p: odd(p["tag"]))
        return ~(cut | named(e, "remove") | (named(e, "remap") & ~remappable(e)))

    def changed(e):
        out = e
        if by["replace"]:
            texts = F.create_map(*[x for t in by["replace"] for x in (F.lit(t).cast("long"), F.lit(acts[t][1]))])
            value = F.when(named(e, "replace"), F.encode(F.try_element_at(texts, e["tag"]), "UTF-8"))
            out = out.withField("value", F.when(named(e, "replace"), value).otherwise(e["value"])).withField("item_count", F.when(~named(e, "replace"), e["item_count"]))
        if by["remap"]:
            out = F.when(named(e, "remap"), out.withField("value", F.encode(values.pseudonymous_uid(values.text(e["value"])), "UTF-8"))).otherwise(out)
        return out

    return decoded.withColumn("elements", F.transform(F.filter("elements", stays), changed))


def apply_rules(elements: DataFrame, rules: DataFrame, remove_private: bool = True) -> DataFrame:
    """Elements, as rows, after the rules: one row a tag, at most LONGEST_LIST of them.

    An element goes if it, or a sequence it lies in, is removed, replaced or private.
    """
    acts = {r["tag"]: r["action"] for r in listed(rules.where("action <> 'keep'").select("tag", "action"))}
    cut = F.lit(False)
    if acts:
        cut = F.exists("path", lambda p: p["tag"].isin(sorted(acts)))
    if remove_private:
        cut = cut | F.exists("path", lambda p: F.shiftright(p["tag"], 16) % 2 == 1) | (F.shiftright("tag", 16) % 2 == 1)
    own = elements.where(~cut).join(small(rules.select("tag", "action", "replacement")), "tag", "left")
    text = values.text("value")
    is_sequence = F.col("item_count").isNotNull()
    remappable = (F.col("vr") == "UI") & ~is_sequence & (F.coalesce(text, F.lit("")) != "")
    gone = (F.col("action") == "remove") | ((F.col("action") == "remap") & ~remappable)
    value = F.when(F.col("action") == "replace", F.encode("replacement", "UTF-8")).when(F.col("action") == "remap", F.encode(values.pseudonymous_uid(text), "UTF-8")).otherwise(F.col("value"))
    # What is replaced is a plain value from then on.
    count = F.when(F.coalesce(F.col("action"), F.lit("")) != "replace", F.col("item_count"))
    return own.where(~F.coalesce(gone, F.lit(False))).withColumns({"value": value, "item_count": count}).select(*elements.columns)
