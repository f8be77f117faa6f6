"""Spectrum records of open libraries, from landed JSON and from an identity index, in one schema.

Columns: spectrum_id, source, license, inchikey, cas, smiles, name, spectrum_type,
ms_level, ion_mode, ionization, adduct, precursor_mz, collision_energy, instrument,
peaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions import measures, spectra
from sillage.operators.ranking import top

FIELDS = ["spectrum_id", "source", "license", "inchikey", "cas", "smiles", "name", "spectrum_type", "ms_level", "ion_mode", "ionization", "adduct", "precursor_mz", "collision_energy", "instrument", "peaks"]
# The fields of the sources' records.
_TAGS = "array<struct<subtag:string,value:string>>"
NESTED = f"""accession string, license string, compound struct<names:array<string>,smiles:string,link:array<struct<`database`:string,identifier:string>>>,
  acquisition struct<instrument:string,instrument_type:string,mass_spectrometry:struct<ms_type:string,ion_mode:string,subtags:{_TAGS}>>,
  mass_spectrometry struct<focused_ion:{_TAGS}>, peak struct<peak:struct<`values`:array<struct<mz:double,intensity:double,rel:double>>>>"""
FLAT = "adduct string, collision_energy string, compound_name string, inchikey string, instrument string, ion_mode string, ion_source string, library string, ms_level int, peaks array<array<double>>, precursor_mz double, smiles string"
ANNOTATED = """annotations array<struct<Compound_Name:string,Ion_Source:string,Instrument:string,Adduct:string,Precursor_MZ:string,CAS_Number:string,Smiles:string,Ion_Mode:string>>,
  spectruminfo struct<ms_level:string,library_membership:string,peaks_json:string>"""


def _tagged(tags: Column, key: str, name: str, value: str) -> Column:
    """The value of the first entry whose key is ``name`` in any case."""
    return F.nullif(F.trim(F.get(F.filter(tags, lambda t: F.lower(t[key]) == name.lower()), 0)[value]), F.lit(""))


def _pairs(peaks: Column) -> Column:
    """Lists of two numbers as peaks; others are left out."""
    good = F.filter(F.coalesce(peaks, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
    return F.transform(good, lambda p: F.struct(F.get(p, 0).alias("mz"), F.get(p, 1).alias("intensity")))


def _record(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    mode = columns["ion_mode"]
    made = columns | {"ion_mode": spectra.ion_mode(mode), "adduct": spectra.adduct(columns["adduct"], mode), "peaks": spectra.normalise(columns["peaks"])}
    return rows.select(F.col(key).alias("key"), *(made[f].alias(f) for f in FIELDS))


def nested_records(answers: DataFrame, *, key: str = "key", payload: str = "payload") -> DataFrame:
    """Records with nested compound, acquisition and peak sections."""
    r = F.col("r")
    rows = answers.select(F.col(key).alias("key"), F.from_json(F.col(payload), NESTED).alias("r")).filter("r.accession is not null")
    ms = r["acquisition"]["mass_spectrometry"]
    ionization = F.upper(F.split_part(F.coalesce(r["acquisition"]["instrument_type"], F.lit("unknown")), F.lit("-"), F.lit(1)))
    level = F.when(F.upper(ms["ms_type"]) == "MS2", 2).otherwise(1)
    energy = F.coalesce(_tagged(ms["subtags"], "subtag", "COLLISION_ENERGY", "value"), _tagged(ms["subtags"], "subtag", "IONIZATION_ENERGY", "value"))
    peaks = F.transform(r["peak"]["peak"]["values"], lambda p: F.struct(p["mz"].alias("mz"), F.coalesce(p["intensity"], p["rel"]).alias("intensity")))
    link = r["compound"]["link"]
    return _record(
        rows, "key", spectrum_id=r["accession"], source=F.lit("nested"), license=F.coalesce(r["license"], F.lit("unknown")), inchikey=_tagged(link, "database", "INCHIKEY", "identifier"), cas=_tagged(link, "database", "CAS", "identifier"),
        smiles=r["compound"]["smiles"], name=F.get(r["compound"]["names"], 0), spectrum_type=F.when(ionization == "EI", "EI").otherwise(F.upper(ms["ms_type"])), ms_level=level, ion_mode=ms["ion_mode"], ionization=ionization,
        adduct=_tagged(r["mass_spectrometry"]["focused_ion"], "subtag", "ION_TYPE", "value"), precursor_mz=F.lit(None).cast("double"), collision_energy=energy, instrument=r["acquisition"]["instrument"], peaks=peaks,
    )


def detail_records(answers: DataFrame, *, key: str = "key", payload: str = "payload") -> DataFrame:
    """Details in either of two layouts: flat, or annotations with peaks as JSON text (bad text gives no peaks)."""
    text = F.col(payload)
    rows = answers.select(F.col(key).alias("key"), F.from_json(text, FLAT).alias("f"), F.from_json(text, ANNOTATED).alias("a"))
    f, info, note = F.col("f"), F.col("a")["spectruminfo"], F.get(F.col("a")["annotations"], 0)
    peaks = F.when(info.isNotNull(), _pairs(F.from_json(F.coalesce(info["peaks_json"], F.lit("[]")), "array<array<double>>"))).otherwise(_pairs(f["peaks"]))
    known = lambda x: F.when(~F.upper(x).isin("N/A", ""), x)
    return _record(
        rows, "key", spectrum_id=F.col("key"), source=F.lit("detail"), license=F.lit("needs_review"), inchikey=f["inchikey"], cas=known(note["CAS_Number"]), smiles=F.coalesce(f["smiles"], note["Smiles"]), name=F.coalesce(f["compound_name"], note["Compound_Name"]),
        spectrum_type=F.lit("MS2"), ms_level=F.coalesce(f["ms_level"], info["ms_level"].try_cast("int"), F.lit(2)), ion_mode=F.coalesce(f["ion_mode"], note["Ion_Mode"]), ionization=F.coalesce(f["ion_source"], note["Ion_Source"], F.lit("unknown")),
        adduct=F.coalesce(f["adduct"], note["Adduct"]), precursor_mz=F.coalesce(f["precursor_mz"], note["Precursor_MZ"].try_cast("double")), collision_energy=f["collision_energy"], instrument=F.coalesce(f["instrument"], note["Instrument"]), peaks=peaks,
    )


def search_index(index: DataFrame, *, inchikey: str | None = None, names: tuple[str, ...] = (), limit: int = 500) -> DataFrame:
    """Rows of an identity index with ``pos``: by full key or its first block, exact ones first; else by the first name that has rows."""
    if inchikey:
        key = inchikey.strip().upper()
        found = index.filter(F.substring("inchikey", 1, 14) == key[:14])
        return top(found, [F.when(F.col("inchikey") == key, 0).otherwise(1), F.col("library_name"), F.col("spectrum_id")], limit)
    low = F.lower(F.regexp_replace(F.trim("compound_name"), r"\s+", " "))
    listed = [" ".join(n.lower().split()) for n in names]
    found = index.withColumn("_n", F.array_position(F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>"), low)).filter("_n > 0")
    first = found.agg(F.min("_n").alias("_n"))
    return top(found.join(F.broadcast(first), "_n").drop("_n"), [F.col("library_name"), F.col("spectrum_id")], limit)  # one row is broadcast


def identified(records: DataFrame, target: dict[str, str]) -> DataFrame:
    """Records with match (type, rank, verified) against a target compound, for ranking."""
    given = {k: F.lit(target.get(k, "")) for k in ("key", "number", "structure", "name")}
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    other = {"key": blank("inchikey"), "number": blank("cas"), "structure": blank("smiles"), "name": blank("name")}
    return records.withColumn("match", measures.identity_rank(given, other))


def union_with_counts(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All sources' records, and their counts: total, EI, MS2, verified, for each source."""
    out = None
    for name, df in sources.items():
        side = df.withColumn("source", F.lit(name))
        out = side if out is None else out.unionByName(side, allowMissingColumns=True)
    counts = out.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("spectrum_type") == "EI").alias("ei"), F.count_if(F.col("spectrum_type") == "MS2").alias("ms2"), F.count_if(F.col("match.verified")).alias("verified"))
    return out, counts
