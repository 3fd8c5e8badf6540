"""Free-entered values mapped to a canonical list by a partition-based pigeonhole join. Built-in SQL functions only.

A reference string of length L allows k(L) edits and is cut into k+1 segments, of which any string within k edits keeps
at least one whole, moved by at most k places. Typed values are made distinct, their substrings at those places are
joined with the segments by equality, and `levenshtein` verifies the pairs. What is left over is found by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimansa.plans.support import checkpointed, hot_safe_join, small

# Other spellings of the entries, by entry.
ALIASES = {
    "tablet": "tab|tabs|tablets|tab s|tblt|goli|goliyan|1 tablet|1 tab|tablet strip|tablets strip|tab strip|uncoated tablet|oral tablet|टैबलेट|टेबलेट|गोली",
    "film-coated tablet": "fc tab|fc tablet|fc tablets|f c tab|f c tablet|f c tablets|film coated tab|film coated tabs|film coated tablets|filmcoated tab|filmcoated tabs|filmcoated tablet|coated film tablet|tablet film coated|tab film coated|tab fc|tablet fc|coated tablet",
    "chewable tablet": "chewable tab|chewable tabs|chewable tablets|chew tab|chew tabs|chewtab|tab chewable|tablet chewable|tab chew|chewing tablet",
    "dispersible tablet": "dt|tab dt|tablet dt|dispersible tab|dispersible tabs|dispersible tablets|dispersable tablet|dispersable tablets|disp tab|disp tablet|tab dispersible|tablet dispersible|d t tablet|d t",
    "effervescent tablet": "effervescent tab|effervescent tabs|effervescent tablets|eff tab|eff tablet|tab effervescent|tablet effervescent|fizzy effervescent tablet|fizzy tablet",
    "sustained release tablet": "sr tab|sr tablet|tab sr|tablet sr|tab s r|tablet s r|s r tablet|sustained release tab|sustained release tablets|sust release tab|sust release tablet|tablet sustained release|extended release tablet|er tablet|xr tablet|prolonged release tablet",
    "capsule": "cap|caps|cap s|capsules|cpsl|hard capsule|hard gelatin capsule|hard cap|1 capsule|कैप्सूल",
    "soft gelatin capsule": "softgel|soft gel|softgel capsule|soft gel cap|soft gel capsule|softgel cap|cap soft gelatin|capsule soft gelatin|soft gelatine caps|soft gelatin cap|soft gelatin caps|soft gelatine capsule|sg capsule|soft capsule",
    "syrup": "syp|syr|syrups|sirup|syrp|oral syrup|liquid syrup|सिरप|सीरप",
    "dry syrup": "dry syp|dry syr|drysyrup|syrup dry|syp dry|dry sirup|powder for syrup",
    "oral suspension": "susp|suspension|oral susp|suspension oral|o/s suspension|o s suspension|susp oral|liquid suspension|oral suspn",
    "oral solution": "oral soln|oral sol|soln oral|sol oral|solution oral|oral liquid",
    "oral drops": "oral drop|drops oral|drop oral|drops oral use|paediatric drops|pediatric drops|paediatric oral drops|pediatric oral drops",
    "eye drops": "eye drop|e/d|e d|drops eye|drop eye|ophthalmic drops|ophthalmic drop|eyedrops|eyedrop|ophthalmic solution|आई ड्रॉप्स|आई ड्रॉप|आँख की दवा",
    "ear drops": "ear drop|drops ear|drop ear|otic drops|otic drop|eardrops|eardrop|ear/drops",
    "nasal drops": "nasal drop|drops nasal|drop nasal|nose drops|nose drop|n/drops|n/drop|n drops|nasaldrops",
    "nasal spray": "spray nasal|nose spray|nasal spry|nasalspray|nasal sprays",
    "eye ointment": "eye oint|oint eye|ointment eye|ointment for eye|ophthalmic ointment|ophthalmic oint|eyeointment|e/o",
    "injection": "inj|injections|injectable|inj vial|injection vial|inj ampoule|injectables|vial injection|इंजेक्शन|इन्जेक्शन|सुई",
    "infusion": "inf|infusions|iv infusion|i v infusion|infusion iv|infusion i v|iv fluid|drip",
    "powder for injection": "powder for inj|pdr for inj|pwd for inj|inj powder|injection powder|dry powder injection|powder injection|dry powder inj|powder for injections",
    "cream": "crm|creams|creme|topical cream|skin cream|क्रीम",
    "ointment": "oint|ointments|skin ointment|topical ointment|मरहम|मलहम",
    "gel": "gels|jel|topical gel|skin gel|जेल",
    "lotion": "lot|lotn|lotions|skin lotion|topical lotion|लोशन",
    "shampoo": "shampoos|medicated shampoo|shampo|शैम्पू",
    "medicated soap": "soap|soap medicated|medicated bar soap|medicated bar|soap bar|bar soap|साबुन",
    "powder": "pwd|pdr|powders|oral powder|powder oral|पाउडर",
    "dusting powder": "dust powder|dusting pwd|dusting pdr|powder dusting|dust pwd",
    "granules": "gran|granule|granules sachet|granules sachets|oral granules|granuals",
    "inhaler": "inh|inhalers|mdi inhaler|mdi|metered dose inhaler|इनहेलर|इन्हेलर",
    "rotacap": "rota cap|rotacaps|roto caps|roto cap|rota caps|rotocap|rotocaps|dpi capsule",
    "respules": "resp|respule|nebuliser respules|nebulizer respules|nebuliser respule|neb respules",
    "transdermal patch": "patch|td patch|skin patch|patch transdermal|transdermal patches|patches",
    "suppository": "supp|suppos|suppositories|rectal suppository|suppository rectal|rectal supp",
    "pessary": "pess|pessaries|vaginal pessary|pessary vaginal",
    "mouthwash": "mouth wash|m wash|m/wash|mouthwashes|oral rinse|mouth rinse",
    "gargle": "gargles|throat gargle|gargle soln|gargle solution|gargling solution|mouth gargle",
    "lozenge": "loz|lozenges|throat lozenge|throat lozenges",
    "toothpaste": "tooth paste|t paste|t/paste|dental paste|toothpastes|dental gel paste",
    "liniment": "liniments|pain liniment|linim|pain oil",
    "elixir": "elix|elixirs|elixer",
    "enema": "enemas|rectal enema|retention enema|enema solution",
    "topical solution": "top soln|topical soln|topical sol|solution topical|soln topical|top solution|topical solutions|top sol",
    "vaginal tablet": "vag tab|vag tablet|vaginal tab|vaginal tabs|vaginal tablets|tablet vaginal|tab vaginal|v/tab",
}


def max_edits(length: Column) -> Column:
    """k(L): none up to 3 letters, then 1 edit, 3 from 9 letters and 4 from 12; two letters changed over are two edits."""
    return F.when(length <= 3, 0).when(length <= 8, 1).when(length <= 11, 3).otherwise(4)


def folded(value: str | Column) -> Column:
    """Lower-cased; all but letters, marks, digits and slashes as single spaces; slashes only within words."""
    bare = F.regexp_replace(F.lower(value), r"[^\p{L}\p{M}\p{N}/]+", " ")
    return F.trim(F.regexp_replace(bare, r" ?/ |/ ?$|^ ?/", " "))


def _refs(forms: DataFrame) -> DataFrame:
    """form_id, ref: the folded entries with their aliases; the table is a given short list, so all of this is small."""
    spark = forms.sparkSession
    aliases = spark.createDataFrame([(f, a) for f, names in ALIASES.items() for a in names.split("|")], "form string, alias string")
    own = forms.where(F.col("form").isNotNull()).select("form_id", folded("form").alias("ref"))
    more = forms.join(F.broadcast(aliases), "form").select("form_id", folded("alias").alias("ref"))
    return own.unionByName(more).where(F.col("ref") != "").groupBy("ref").agg(F.min("form_id").alias("form_id"))


def _segments(length: Column) -> Column:
    """The k+1 segments of a string of some length, as (no, start from 1, size): even cuts, the longer ones last."""
    k = max_edits(length)
    cut = lambda i: F.floor(length * i / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("no"), (cut(i) + 1).alias("start"), (cut(i + 1) - cut(i)).alias("size")))


def nearest(typed: DataFrame, refs: DataFrame) -> DataFrame:
    """typed, form_id, distance: the closest reference of every distinct `typed` that has one within its edits.

    Ties go to fewer edits, then to the longer reference, then to the smaller form_id. References of any length take
    part; the places are made for the lengths that occur.
    """
    sized = refs.where(F.length("ref") > 0).withColumn("len", F.length("ref"))
    cut = sized.withColumn("s", F.explode(_segments(F.col("len")))).select("ref", "form_id", "len", F.col("s.no").alias("no"), F.expr("substring(ref, s.start, s.size)").alias("piece"))
    # where a typed value of length n may hold the pieces of references of length len
    lengths = sized.select("len").distinct().withColumn("k", max_edits(F.col("len")))
    places = (
        lengths.withColumn("s", F.explode(_segments(F.col("len"))))
        .withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("len") - F.col("k")), F.col("len") + F.col("k"))))
        .withColumn("at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("s.start") - F.col("k")), F.col("s.start") + F.col("k"))))
        .where(F.col("at") + F.col("s.size") - 1 <= F.col("n"))
        .select("n", "len", F.col("s.no").alias("no"), "at", F.col("s.size").alias("size"))
    )
    probes = typed.withColumn("n", F.length("typed")).join(small(places), "n").select("typed", "len", "no", F.expr("substring(typed, at, size)").alias("piece")).distinct()
    pairs = probes.join(small(cut), ["len", "no", "piece"]).select("typed", "ref", "form_id").distinct()
    close = pairs.withColumn("distance", F.levenshtein("typed", "ref")).where(F.col("distance") <= max_edits(F.length("ref")))
    best = F.min(F.struct("distance", (-F.length("ref")).alias("shorter"), "form_id")).alias("b")
    return close.groupBy("typed").agg(best).select("typed", F.col("b.form_id").alias("form_id"), F.col("b.distance").alias("distance"))


def mapped(values: DataFrame, forms: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, form_id of every row whose value is neither null nor blank nor letter for letter an entry; 0 if it fits none.

    Values without any letter or digit fit none. Every row is kept, repeated ones too.
    """
    rows = values.where(F.col(value).isNotNull() & (F.regexp_replace(F.col(value), r"(?U)[\s\p{Z}]+", "") != ""))
    known = forms.where(F.col("form").isNotNull()).select(F.col("form").alias("_form")).distinct()
    rows = rows.join(small(known), F.col(value) == F.col("_form"), "left_anti").select(*keys, folded(value).alias("typed"))
    counted = checkpointed(rows.groupBy("typed").agg(F.count("*").alias("n_rows")))
    fits = checkpointed(nearest(counted.select("typed"), _refs(forms)))
    none = counted.join(fits, "typed", "left_anti").select("typed", F.lit(0).alias("form_id"))
    every = fits.select("typed", "form_id").unionByName(none).join(counted, "typed")
    return hot_safe_join(rows, every, ["typed"], "n_rows").select(*keys, F.col("form_id").cast("int").alias("form_id"))


def found(medicines: DataFrame, records: DataFrame, forms: DataFrame) -> DataFrame:
    """src, ref_id, form_id of the medicines and medicine_records tables."""
    one = medicines.select(F.lit("medicines").alias("src"), F.col("row_id").alias("ref_id"), F.col("dosage_form").alias("v"))
    two = records.select(F.lit("medicine_records").alias("src"), F.col("record_id").alias("ref_id"), F.col("form").alias("v"))
    return mapped(one.unionByName(two), forms, ["src", "ref_id"], "v")
