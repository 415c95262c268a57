"""Places and ways of working read from location strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names a place. Patterns hold in Java and in RE2 alike.
BAY_AREA = r"\b(bay area|silicon valley|san francisco|oakland|berkeley|palo alto|mountain view|sunnyvale|san jose|fremont|menlo park|redwood city|cupertino|santa clara)\b"
CALIFORNIA = r"\b(california|los angeles|san diego|sacramento|irvine|fresno|santa monica|long beach)\b"
US_NAME = r"\b(united states|usa|u\.s\.a?|us|america)\b"
US_STATE = (
    r"\b(alabama|alaska|arizona|arkansas|colorado|connecticut|delaware|florida|georgia|hawaii|idaho|illinois|indiana|iowa|kansas|kentucky|louisiana|maine|maryland|"
    r"massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska|nevada|new hampshire|new jersey|new mexico|new york|north carolina|north dakota|ohio|oklahoma|"
    r"oregon|pennsylvania|rhode island|south carolina|south dakota|tennessee|texas|utah|vermont|virginia|washington|west virginia|wisconsin|wyoming)\b"
)
US_CITY = r"\b(nyc|seattle|austin|boston|chicago|denver|atlanta|houston|dallas|miami|portland|philadelphia|phoenix)\b"
STATE_CODE = r"(^|, ?| - |\()(AL|AK|AZ|AR|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC)\b"
CA_CODE = r"(^|, ?| - |\()CA\b"
FOREIGN_SUBDIVISION = r", ?(ON|BC|QC|AB|NSW|VIC)\b"
FOREIGN_NAME = r"\b(canada|united kingdom|uk|england|germany|france|spain|india|ireland|poland|netherlands|singapore|japan|brazil|mexico|australia|emea|apac|europe)\b"
FOREIGN_CITY = r"\b(london|berlin|munich|paris|madrid|bangalore|bengaluru|dublin|warsaw|amsterdam|tokyo|toronto|vancouver|sydney|zurich|lisbon)\b"
NO_PLACE = r"^(remote|hybrid|flexible|on-?site|anywhere|in office|wfh|[0-9]+ locations|[ /|,;-])*$"
#: Class, and its place in a feed.
RANKS = {"bay_area": 0, "california": 1, "united_states": 2, "unknown": 3, "unplaced": 4, "elsewhere": 5}
REMOTE = r"\b(remote|work from home|wfh|anywhere|distributed)\b"
DENIED = r"\b(no|not|non)[ -](a )?remote\b|\bremote (work )?(is )?not\b"
ONSITE = r"\b(on-?site|hybrid|in[ -]office)\b"
#: Other spellings of a wanted place.
ALIASES = {"ca": r"california|ca", "california": r"california|ca", "ny": r"new york|nyc|ny", "uk": r"united kingdom|england|uk", "us": r"united states|usa|us"}


def folded(text: Column) -> Column:
    """Accents of Latin letters off."""
    return F.translate(F.coalesce(text, F.lit("")), "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÅÉÈÊËÍÎÓÔÖÚÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIOOOUUUNC")


def locality(location: Column) -> Column:
    """One of RANKS. The order of the rules is the design: a foreign subdivision or country
    settles it before `CA` can be California, a state code before a city that two states share."""
    raw = F.trim(folded(location))
    low = F.lower(raw)
    california = low.rlike(CALIFORNIA) | raw.rlike(CA_CODE)
    domestic = raw.rlike(STATE_CODE) | california | low.rlike(BAY_AREA) | low.rlike(US_NAME)
    return (
        F.when(low.rlike(NO_PLACE), "unknown")
        .when(raw.rlike(FOREIGN_SUBDIVISION), "elsewhere")
        .when(low.rlike(FOREIGN_NAME) & ~(raw.rlike(STATE_CODE) | low.rlike(CALIFORNIA) | low.rlike(US_NAME)), "elsewhere")
        .when(raw.rlike(STATE_CODE) & ~raw.rlike(CA_CODE), "united_states")
        .when(low.rlike(BAY_AREA), "bay_area")
        .when(california, "california")
        .when(domestic | low.rlike(US_STATE) | low.rlike(US_CITY), "united_states")
        .when(low.rlike(FOREIGN_CITY), "elsewhere")
        .otherwise("unplaced")
    )


def locality_sql(col: str) -> str:
    """The same rules in DuckDB SQL, for a column that holds ASCII text."""
    m = lambda p, low=True: f"regexp_matches({'lower(' if low else '('}trim({col})), '{p}')"
    cal = f"({m(CALIFORNIA)} OR {m(CA_CODE, False)})"
    return (
        f"CASE WHEN {m(NO_PLACE)} THEN 'unknown' WHEN {m(FOREIGN_SUBDIVISION, False)} THEN 'elsewhere' "
        f"WHEN {m(FOREIGN_NAME)} AND NOT ({m(STATE_CODE, False)} OR {m(CALIFORNIA)} OR {m(US_NAME)}) THEN 'elsewhere' "
        f"WHEN {m(STATE_CODE, False)} AND NOT {m(CA_CODE, False)} THEN 'united_states' WHEN {m(BAY_AREA)} THEN 'bay_area' WHEN {cal} THEN 'california' "
        f"WHEN {m(STATE_CODE, False)} OR {m(US_NAME)} OR {m(US_STATE)} OR {m(US_CITY)} THEN 'united_states' WHEN {m(FOREIGN_CITY)} THEN 'elsewhere' ELSE 'unplaced' END"
    )


def locality_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in RANKS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def offices(location: Column) -> Column:
    """The places of a string that lists several, split at ; | / and ` or `; none for a count of locations."""
    parts = F.transform(F.split(F.coalesce(location, F.lit("")), r" ?[;|/] ?| or "), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^[0-9]+ [Ll]ocations?$"))


def remote_by_metadata(title: Column, location: Column) -> Column:
    """Whether title and location say remote; null where only the body can tell."""
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(location, F.lit(""))))
    return F.when(t.rlike(DENIED), False).when(t.rlike(REMOTE), True).when(t.rlike(ONSITE), False)


def reads_as_remote(title: Column, location: Column, body: Column) -> Column:
    """Metadata decides where it can, else a body that says remote and does not deny it."""
    b = F.lower(F.coalesce(body, F.lit("")))
    return F.coalesce(remote_by_metadata(title, location), b.rlike(REMOTE) & ~b.rlike(DENIED))


def mentions_place(location: Column, wanted: str) -> Column:
    """Whether a location names a wanted place as whole words in any of its spellings, in the country that the place is in."""
    names = ALIASES.get(wanted.lower(), wanted.lower())
    says = F.lower(folded(location)).rlike(rf"\b({names})\b")
    return says & (locality(location) != "elsewhere") if wanted.lower() in ("ca", "california", "ny", "us") else says


def in_area(location: Column, remote: Column) -> Column:
    """Whether any office can be reached: California in any way of working, the rest of the country remotely, nothing abroad; unknown places pass."""

    def one(x: Column) -> Column:
        c = locality(x)
        return c.isin("bay_area", "california", "unknown") | ((c == "united_states") & remote)

    return F.when(F.size(offices(location)) == 0, True).otherwise(F.exists(offices(location), one))
