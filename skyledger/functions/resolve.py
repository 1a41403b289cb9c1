"""Raw header values to canonical ones: filters, kinds, cameras, sky objects."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions import text

# Filter names as written to their canonical form, and names for no filter.
FILTERS = {
    "H": "Ha", "HA": "Ha", "H-ALPHA": "Ha", "HALPHA": "Ha", "HYDROGEN": "Ha", "HA3NM": "Ha", "HA-3NM": "Ha", "HA 3NM": "Ha",
    "S": "SII", "S2": "SII", "SII": "SII", "S-II": "SII", "SULFUR": "SII", "SULPHUR": "SII",
    "O": "OIII", "O3": "OIII", "OIII": "OIII", "O-III": "OIII", "OXYGEN": "OIII",
    "L": "L", "LUM": "L", "LUMINANCE": "L", "LUMINANCIA": "L", "R": "R", "RED": "R", "G": "G", "GREEN": "G", "B": "B", "BLUE": "B",
    "L-PRO": "L-Pro", "LPRO": "L-Pro", "L PRO": "L-Pro", "L-EXTREME": "L-eXtreme", "L-EX": "L-eXtreme", "LEXTREME": "L-eXtreme", "L-EX3": "L-eXtreme", "LEXT": "L-eXtreme",
    "L-ENHANCE": "L-eNhance", "LENHANCE": "L-eNhance", "L-ENH": "L-eNhance", "L-ULTIMATE": "L-Ultimate", "LULTIMATE": "L-Ultimate", "CLS": "CLS", "CLS-CCD": "CLS",
}
NO_FILTER = ["NOFILTER", "NONE", "NO FILTER", "CLEAR", "C", "EMPTY"]

# Image types and folder names of frame kinds.
KINDS = {"light": "light", "flat": "flat", "dark": "dark", "bias": "bias", "master flat": "master_flat", "master dark": "master_dark", "master light": "master_light", "integration": "master_light"}
KIND_FOLDERS = {"light": "light", "lights": "light", "dark": "dark", "darks": "dark", "flat": "flat", "flats": "flat", "bias": "bias", "biases": "bias"}

# Grammars of catalogue designations, as (pattern, prefix of the canonical form; None: the first group).
DESIGNATIONS = [
    (r"^(?:M|MESSIER)\s*0*(\d{1,3})$", "M"),
    (r"^(?:C|CALDWELL)\s*0*(\d{1,3})$", "C"),
    (r"^(NGC|IC|UGC|PGC)\s*0*(\d{1,5})$", None),
    (r"^SH\s*2?\s*-?\s*0*(\d{1,3})$", "Sh2-"),
    (r"^(LBN|LDN)\s*0*(\d{1,4})$", None),
    (r"^CTB\s*0*(\d{1,3})$", "CTB"),
    (r"^(?:B|BARNARD)\s*0*(\d{1,3})$", "B"),
    (r"^ABELL\s*0*(\d{1,4})$", "Abell"),
    (r"^(?:VDB|VAN\s*DEN\s*BERGH)\s*0*(\d{1,4})$", "vdB"),
    (r"^CED(?:ERBLAD)?\s*0*(\d{1,4})$", "Ced"),
    (r"^(?:CR|COLLINDER)\s*0*(\d{1,4})$", "Cr"),
]
# Designations that another catalogue's takes the place of.
SAME_OBJECT = {
    "M31": "NGC224", "M42": "NGC1976", "M51": "NGC5194", "M81": "NGC3031", "M82": "NGC3034", "M92": "NGC6341", "M101": "NGC5457", "M106": "NGC4258",
    "C3": "NGC4236", "C4": "NGC7023", "C12": "NGC6946", "C23": "NGC891", "C33": "NGC6992", "Sh2-190": "IC1805", "Sh2-184": "NGC281", "UGC7772": "NGC4565", "LDN1174": "NGC7023",
}
# Catalogue labels by the prefix before a digit, longest first.
LABELS = {
    "NGC": "NGC", "IC": "IC", "Sh2-": "Sh2", "UGC": "UGC", "PGC": "PGC", "LBN": "LBN", "LDN": "LDN", "Abell": "Abell", "vdB": "vdB", "Ced": "Ced",
    "Cr": "Collinder", "CTB": "CTB", "B": "Barnard", "M": "Messier", "C": "Caldwell",
}
# Common names, by letters and digits only.
COMMON_NAMES = {
    "ROSETTE": "NGC2237", "HEART": "IC1805", "SOUL": "IC1848", "PELICAN": "IC5070", "NORTHAMERICA": "NGC7000", "ELEPHANTSTRUNK": "Sh2-131", "BODES": "M81",
    "CIGAR": "M82", "FLAMINGSTAR": "IC405", "BUBBLE": "NGC7635",
}
# Bodies of the solar system and known comets.
BODIES = {
    "KSIEZYC": "Moon", "MOON": "Moon", "LUNA": "Moon", "SLONCE": "Sun", "SUN": "Sun", "MERKURY": "Mercury", "MERCURY": "Mercury", "WENUS": "Venus", "VENUS": "Venus",
    "MARS": "Mars", "JOWISZ": "Jupiter", "JUPITER": "Jupiter", "SATURN": "Saturn", "URAN": "Uranus", "URANUS": "Uranus", "NEPTUN": "Neptune", "NEPTUNE": "Neptune",
}
COMETS = {"C/2025 A6": "C/2025 A6 (Lemmon)", "C/2023 A3": "C/2023 A3 (Tsuchinshan-ATLAS)", "21P": "21P/Giacobini-Zinner"}
COMET_NAMES = {"LEMMON": "C/2025 A6", "TSUCHINSHAN": "C/2023 A3", "GIACOBINI": "21P"}
COMET_DESIGNATION = r"(?<![A-Z0-9])([CPDX])[ /_-]?(\d{4})[ _-]?([A-Z]\d{1,3})\b"


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def filter_name(raw: Column) -> Column:
    """Null for none and for a bare wheel slot; an unknown name stays as it is written."""
    raw = text.to_text(raw)
    key = text.norm(raw)
    nothing = key.isin(NO_FILTER) | key.rlike(r"^\d+$")
    return F.when(raw.isNotNull() & ~nothing, F.coalesce(looked_up(FILTERS, key), F.trim(raw)))


def kind(imagetyp: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(imagetyp)), r"[\s_]+", " "), " frame$", "")
    return F.coalesce(looked_up(KINDS, key), F.lit("unknown"))


def kind_of_path(path: Column) -> Column:
    """By the first folder from the root that names a kind."""
    named = F.transform(text.parts(path), lambda p: looked_up(KIND_FOLDERS, F.lower(F.trim(p))))
    return F.coalesce(F.get(F.filter(named, lambda k: k.isNotNull()), F.lit(0)), F.lit("unknown"))


def camera(instrume: Column) -> Column:
    """A camera model without maker, punctuation and body variants."""
    s = text.norm(instrume)
    number, suffix = (F.regexp_extract(s, r"ASI\s?0*(\d{3,4})\s?(MM|MC|MD)?", g) for g in (1, 2))
    suffix = F.when((suffix == "MM") & s.rlike(r"\bDUO\b"), "MD").otherwise(suffix)
    other = s
    for pattern, name in ((r"\bILCE-?7RM3A?\b", "A7RM3"), (r"\bILCE-?7M3\b", "A7M3"), (r"\bILCE-?7S\b", "A7S"), (r"\b(ZWO|PRO|CAMERA|CMOS|CCD)\b", ""), (r"[^A-Z0-9]+", "")):
        other = F.regexp_replace(other, pattern, name)
    return F.when(number != "", F.concat(F.lit("ASI"), number, suffix)).otherwise(F.nullif(other, F.lit("")))


def is_mono(bayerpat: Column, model: Column, raw_format: Column) -> Column:
    """struct(is_mono 1, 0 or null, source): what the header proves, in the order of its strength."""
    told = lambda value, source: F.struct(F.lit(value).cast("int").alias("is_mono"), F.lit(source).alias("source"))
    return (
        F.when(text.to_text(bayerpat).isNotNull(), told(0, "bayerpat"))
        .when(F.endswith(model, F.lit("MC")), told(0, "model"))
        .when(F.endswith(model, F.lit("MM")) | F.endswith(model, F.lit("MD")), told(1, "model"))
        .when(text.to_text(raw_format).isNotNull(), told(0, "raw_format"))
        .otherwise(told(None, "review"))
    )


def camera_identity(instrume: Column, bayerpat: Column, raw_format: Column) -> Column:
    """The camera model, with its colour suffix where a maker left it out and the header proves it."""
    model = camera(instrume)
    colour = is_mono(bayerpat, model, raw_format)["is_mono"] == 0
    return F.when(colour & model.rlike(r"^ASI\d+$"), F.concat(model, F.lit("MC"))).otherwise(model)


def _designated(key: Column) -> Column:
    ways = []
    for pattern, prefix in DESIGNATIONS:
        number = F.regexp_extract(key, pattern, 1 if prefix else 2).try_cast("int").cast("string")
        ways.append(F.when(key.rlike(pattern), F.concat(F.lit(prefix) if prefix else F.regexp_extract(key, pattern, 1), number)))
    return F.coalesce(*ways)


def designation(raw: Column) -> Column:
    """The catalogue designation that the whole text is, or its part before an underscore."""
    key = text.norm(raw)
    return F.coalesce(_designated(key), F.when(F.contains(key, F.lit("_")), _designated(F.trim(F.substring_index(key, "_", 1)))))


def preferred(canon: Column) -> Column:
    return F.coalesce(looked_up(SAME_OBJECT, canon), canon)


def catalogue(canon: Column) -> Column:
    return F.coalesce(*(F.when(canon.rlike(rf"^{prefix}\d"), label) for prefix, label in LABELS.items()))


def common_name(raw: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(text.norm(raw), r"^THE\s+", ""), r"\s+(NEBULA|GALAXY|CLUSTER|COMPLEX)$", "")
    return looked_up(COMMON_NAMES, text.norm_alnum(key))


def solar(raw: Column) -> Column:
    """A comet by designation, then by name, then a body by its exact name."""
    u = text.norm_ascii(raw)
    groups = [F.regexp_extract(u, COMET_DESIGNATION, g) for g in (1, 2, 3)]
    written = F.when(u.rlike(COMET_DESIGNATION), F.concat(groups[0], F.lit("/"), groups[1], F.lit(" "), groups[2]))
    named = F.coalesce(*(F.when(u.rlike(rf"(?<![A-Z]){name}(?![A-Z])"), F.lit(canon)) for name, canon in COMET_NAMES.items()))
    comet = F.coalesce(written, named)
    return F.coalesce(looked_up(COMETS, comet), comet, looked_up(BODIES, u))


def sky_object(raw: Column) -> Column:
    """struct(canon, source): solar system first, then catalogue designations, then common names."""
    raw = text.to_text(raw)
    answer = lambda canon, source: F.struct(canon.alias("canon"), source.alias("source"))

    def first(found: Column) -> Column:
        body, own, named = found["body"], found["own"], found["named"]
        return (
            F.when(body.isNotNull(), answer(body, F.when(body.isin(*sorted(set(BODIES.values()))), "solar").otherwise("comet")))
            .when(own.isNotNull(), answer(preferred(own), F.when(preferred(own) == own, "header").otherwise("catalog_xref")))
            .when(named.isNotNull(), answer(preferred(named), F.lit("common_name")))
        )

    # An array of one, so that each way is worked out once and not wherever its answer is used.
    ways = F.struct(solar(raw).alias("body"), designation(raw).alias("own"), common_name(raw).alias("named"))
    return F.get(F.transform(F.array(ways), first), F.lit(0))
