"""Fixed values of the public feed and of its analytics.

Everything in this file must hold exactly these values for results to be right;
nothing here is logic.
"""

# --- key -------------------------------------------------------------------
CASE_ID = "CASE_ID"

# --- fixed values: raw columns, in feed order (the leading id column is CASE_ID)
SUBMISSION_COLUMNS = [
    "CASE_ID", "RECVDATE", "STATE", "AGE_YRS", "CAGE_YR", "CAGE_MO", "SEX", "RPT_DATE",
    "SYMPTOM_TEXT", "DIED", "DATEDIED", "L_THREAT", "ER_VISIT", "HOSPITAL", "HOSPDAYS",
    "X_STAY", "DISABLE", "RECOVD", "VAX_DATE", "ONSET_DATE", "NUMDAYS", "LAB_DATA",
    "V_ADMINBY", "V_FUNDBY", "OTHER_MEDS", "CUR_ILL", "HISTORY", "PRIOR_VAX", "SPLTTYPE",
    "FORM_VERS", "TODAYS_DATE", "BIRTH_DEFECT", "OFC_VISIT", "ER_ED_VISIT", "ALLERGIES",
]
VACCINE_COLUMNS = [
    "CASE_ID", "VAX_TYPE", "VAX_MANU", "VAX_LOT", "VAX_DOSE_SERIES", "VAX_ROUTE",
    "VAX_SITE", "VAX_NAME",
]
TERM_COLUMNS = [
    "CASE_ID", "SYMPTOM1", "SYMPTOMVERSION1", "SYMPTOM2", "SYMPTOMVERSION2", "SYMPTOM3",
    "SYMPTOMVERSION3", "SYMPTOM4", "SYMPTOMVERSION4", "SYMPTOM5", "SYMPTOMVERSION5",
]
METADATA_COLUMNS = ["REPORT_ORDER", "IS_DOMESTIC", "FILE_NAME", "FILE_LINE_NO"]
ORDER_COLUMN = "ORDER"

# --- fixed values: types that are not text
DATE_COLUMNS = ["RECVDATE", "RPT_DATE", "DATEDIED", "VAX_DATE", "ONSET_DATE", "TODAYS_DATE"]
DOUBLE_COLUMNS = ["AGE_YRS", "CAGE_YR", "CAGE_MO"]
INTEGER_COLUMNS = ["HOSPDAYS", "NUMDAYS"]
FEED_DATE_FORMAT = "M/d/yyyy"

# --- fixed values: windows-1252 characters at bytes 0x80..0x9F (unassigned -> U+FFFD)
CP1252_HIGH = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"

# --- fixed values: Unicode space separators (category Zs), stripped by trim
SPACE_SEPARATORS = (
    "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u202f\u205f\u3000"
)

# --- fixed values: texts that mean "nothing stated" (compared trimmed, lower-cased)
NULL_LIKE = [
    "unknown", "unk", "na", "no", "n/a", "none", "none;", "none.", "none known",
    "no known allergies", "nkda", "nka", "no known drug allergy",
    "no know drug or food allergies",
    "no allergies to medications, food, or other products",
    "none reported", "none on file", "not stated", "no relevant history;",
    "no relevant history", "no relevant hx", "no relevant hx;", "no relevant hx.",
    "no hx of drug allergy",
]
JUNK_LOTS = ["unk", "unknown", "no batch number"]

# --- fixed values: history fields and outcome flags, in display order
HISTORY_FIELDS = ["OTHER_MEDS", "CUR_ILL", "HISTORY", "ALLERGIES", "LAB_DATA"]
OUTCOME_FLAGS = [
    "DIED", "L_THREAT", "HOSPITAL", "DISABLE", "RECOVD", "ER_VISIT", "ER_ED_VISIT",
    "X_STAY", "BIRTH_DEFECT", "OFC_VISIT", "V_ADMINBY", "V_FUNDBY",
]
# reaction label -> (column, value that flags it), in panel order
REACTIONS = {
    "DIED": ("DIED", "Y"),
    "HOSPITAL": ("HOSPITAL", "Y"),
    "L_THREAT": ("L_THREAT", "Y"),
    "DISABLE": ("DISABLE", "Y"),
    "ER_VISIT": ("ER_VISIT", "Y"),
    "ER_ED_VISIT": ("ER_ED_VISIT", "Y"),
    "X_STAY": ("X_STAY", "Y"),
    "!RECOVED": ("RECOVD", "N"),
}
# order in which the value picker offers the reactions
REACTION_CHOICES = [
    "DIED", "HOSPITAL", "L_THREAT", "DISABLE", "!RECOVED", "ER_VISIT", "ER_ED_VISIT", "X_STAY",
]
# dossier outcome label -> (column, value)
OUTCOME_LABELS = {
    "DIED": ("DIED", "Y"),
    "LIFE-THREAT": ("L_THREAT", "Y"),
    "HOSPITAL": ("HOSPITAL", "Y"),
    "DISABLED": ("DISABLE", "Y"),
    "ER": ("ER_VISIT", "Y"),
    "ER/ED": ("ER_ED_VISIT", "Y"),
    "NOT RECOVERED": ("RECOVD", "N"),
}

# --- fixed values: bins
# label -> [low, high), high None = open
AGE_BUCKETS = {
    "0-1": (0, 1), "1-2": (1, 2), "2-4": (2, 4), "4-10": (4, 10), "10-20": (10, 20),
    "20-40": (20, 40), "40-60": (40, 60), "60+": (60, None),
}
# label -> highest day in the bin, None = open
LAG_BINS = {
    "<0": -1, "0-7": 7, "8-30": 30, "31-90": 90, "91-365": 365, "366-730": 730, "731+": None,
}
FOLLOWUP_BINS = {"0": 0, "1": 1, "2": 2, "3-5": 5, "6+": None}
ONSET_DAYS = range(0, 20)
NUM_VAX_RANGE = range(1, 9)
SINGLE_YEARS = range(0, 20)
MAX_NUMDAYS = 10000

# --- fixed values: filterable fields and what each allows
STRING_FIELDS = [
    "STATE", "SEX", "DIED", "L_THREAT", "HOSPITAL", "DISABLE", "RECOVD", "ER_VISIT",
    "ER_ED_VISIT", "X_STAY", "BIRTH_DEFECT", "OFC_VISIT", "V_ADMINBY", "V_FUNDBY",
]
NUMBER_FIELDS = ["AGE_YRS", "NUMDAYS", "NUM_VAX", "FOLLOWUP_COUNT"]
BOOLEAN_FIELDS = ["IS_DOMESTIC"]
LIST_FIELDS = ["VAX_TYPES", "HAS_DATA"]
SCALAR_OPS = ["=", "!=", ">", "<", ">=", "<="]
MEMBER_OPS = ["=", "!="]
DATE_AXES = ["VAX_DATE", "RECVDATE"]
DEFAULT_RATE = 100

# --- fixed values: limits
TOP_LABELS = 15
TOP_MANUFACTURERS = 10
TOP_SIGNIFICANT = 10
MIN_FOREGROUND = 5
MIN_BACKGROUND = 25
MAX_TERMS = 65535
PAGE_SIZE = 25
PAGE_LIMIT_DEFAULT = 50
PAGE_LIMIT_MAX = 500
SORT_FIELDS = ["VAX_DATE", "AGE_YRS", "NUMDAYS", "NUM_VAX", "FOLLOWUP_COUNT", "CASE_ID"]
EXCERPT_LINES = 10
ENUM_VALUE_LIMIT = 200
NUMERIC_VALUE_LIMIT = 20
TERM_SUGGESTIONS = 50
VAX_TYPE_LIMIT = 500
MAX_PANEL_KEYS = 40

# --- fixed values: named panel sets: (first keys, deferred keys, date axis)
VIEWS = {
    "overview": (
        ["total", "events_by_year", "sparkline", "onset_days", "vax_types", "num_vax", "age",
         "age_u20", "reactions", "symptoms"], [], "VAX_DATE"),
    "people": (
        ["total", "events_by_year", "age", "age_u20", "vax_types", "symptoms", "reactions",
         "states", "sex", "has_data"], [], "VAX_DATE"),
    "vaccine": (
        ["total", "events_by_year", "num_vax", "vax_types", "manufacturers", "v_adminby",
         "v_fundby"],
        ["vax_route", "vax_site", "vax_dose_series", "vax_combos"], "VAX_DATE"),
    "all": (
        ["total", "events_by_recvdate", "vax_types", "reactions", "has_data", "age", "age_u20",
         "num_vax"], [], "RECVDATE"),
    "data-quality": (
        ["no_vaxdate_pct", "no_vaxdate_by_recvdate", "lag", "deaths", "died_series",
         "followup_dist", "has_data", "vax_lot"], [], "VAX_DATE"),
}
DEFAULT_VIEW = "overview"
