"""Fixed values of the text keys: word lists and patterns that results depend on."""

# Normalised values that mean "no value".
JUNK = ("", "na", "n a", "nan", "null", "none", "nil", "not available", "not applicable", "unknown", "xxx", "0", "test")

NAME_CANON = {
    "private limited": "pvt ltd", "private ltd": "pvt ltd", "pvt limited": "pvt ltd", "pvtltd": "pvt ltd",
    "private": "pvt", "limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co",
    "limited liability company": "llc", "limited liability partnership": "llp", "public limited company": "plc", "and": "&",
    "brothers": "bros", "international": "intl", "technologies": "tech", "technology": "tech",
    "enterprise": "enterprises", "centre": "center", "service": "services", "industry": "industries",
    "shree": "sri", "shri": "sri", "sree": "sri", "shreee": "sri", "shrii": "sri", "saint": "st",
    "elelpi": "llp", "pra li": "pvt ltd",
}
ADDR_CANON = {
    "road": "rd", "street": "st", "avenue": "ave", "av": "ave", "boulevard": "blvd", "lane": "ln",
    "drive": "dr", "court": "ct", "place": "pl", "highway": "hwy", "parkway": "pkwy", "suite": "ste",
    "apartment": "apt", "apartments": "apt", "building": "bldg", "floor": "flr", "sector": "sec",
    "number": "no", "near": "nr", "opposite": "opp", "behind": "bhd", "junction": "jn",
    "north": "n", "south": "s", "east": "e", "west": "w", "saint": "st", "mount": "mt",
    "post office": "po", "district": "dist", "chauk": "chowk", "ngr": "nagar",
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th",
}

# Legal forms stripped from the end of a name, everywhere and by country.
LEGAL_SUFFIXES = ("pvt ltd", "pvt", "ltd", "llc", "inc", "corp", "co", "llp", "pllc", "plc", "pc", "lp", "pa", "gmbh")
LEGAL_SUFFIXES_BY_COUNTRY = {"INDIA": ("opc",), "FRANCE": ("sarl", "sas", "sasu", "sa", "eurl", "snc", "sci", "scp", "selarl", "sca")}

LANDMARKS = ("nr", "near", "opp", "opposite", "bhd", "behind", "beside", "besides", "next to", "adjacent", "adj", "landmark", "in front of", "infront of", "close to", "above", "below")
TLDS = ("co.in", "org.in", "net.in", "firm.in", "gen.in", "ind.in", "co.uk", "com", "net", "org", "in", "co", "io", "biz", "info", "us", "fr", "online", "store", "shop", "site", "app", "tech", "xyz")
ALIAS_PHRASES = ("doing business as", "formerly known as", "also known as")
ALIAS_SLASHES = ("d/b/a", "f/k/a", "a/k/a")
LEET = {"0": "o", "1": "l", "3": "e", "5": "s"}
LEET_INNER, LEET_LEADING = 4, 6  # letters a word must have
PHONE_DIGITS = 10
MULTI_LOCATION_TOKENS = 22

# Postal patterns by country, in order; the last match of the first that hits.
POSTAL = {"US": (r"^.*\b(\d{5})(?: \d{4})?\b",), "INDIA": (r"^.*\b(\d{6})\b", r"^.*\b(\d{3} \d{3})\b"), "FRANCE": (r"^.*\b(\d{5})\b", r"^.*\b(\d{2} \d{3})\b")}
POSTAL_DEFAULT = (r"^.*\b(\d{5,6})\b",)

COUNTRY_ALIASES = {
    "USA": "US", "U S A": "US", "U S": "US", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "AMERICA": "US",
    "IN": "INDIA", "IND": "INDIA", "BHARAT": "INDIA", "REPUBLIC OF INDIA": "INDIA", "FR": "FRANCE", "FRA": "FRANCE", "REPUBLIQUE FRANCAISE": "FRANCE",
}

# Phonetic folds, in order.
DIGRAPHS = (("ph", "f"), ("gh", "g"), ("kh", "k"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("jh", "j"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("z", "j"), ("w", "v"))
NASAL_BEFORE = "cdfgjklnqrstvxz"

# Scripts by ranges of code points.
SCRIPTS = {
    "latin": ("0041-005A", "0061-007A", "00C0-024F", "1E00-1EFF"), "greek": ("0370-03FF",), "cyrillic": ("0400-04FF",), "arabic": ("0600-06FF", "0750-077F"),
    "devanagari": ("0900-097F",), "bengali": ("0980-09FF",), "gurmukhi": ("0A00-0A7F",), "gujarati": ("0A80-0AFF",), "oriya": ("0B00-0B7F",), "tamil": ("0B80-0BFF",),
    "telugu": ("0C00-0C7F",), "kannada": ("0C80-0CFF",), "malayalam": ("0D00-0D7F",), "sinhala": ("0D80-0DFF",), "thai": ("0E00-0E7F",), "japanese": ("3040-30FF",),
    "cjk": ("4E00-9FFF",), "hangul": ("AC00-D7AF",),
}

# Words of addresses and names for the resolver's keys.
ABBR_FR = {
    "r": "rue", "bd": "boulevard", "bld": "boulevard", "blvd": "boulevard", "boul": "boulevard", "av": "avenue", "ave": "avenue", "aven": "avenue",
    "pl": "place", "ch": "chemin", "che": "chemin", "chem": "chemin", "rte": "route", "imp": "impasse", "all": "allee", "sq": "square",
    "fbg": "faubourg", "faub": "faubourg", "crs": "cours", "qu": "quai", "qua": "quai", "pas": "passage", "sen": "sentier", "res": "residence",
    "resid": "residence", "lot": "lotissement", "za": "zone", "zi": "zone", "zac": "zone", "st": "saint", "ste": "sainte", "prom": "promenade",
    "espl": "esplanade", "mte": "montee", "ham": "hameau", "vla": "villa", "pte": "porte",
}
ABBR_EN = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "dr": "drive",
    "ln": "lane", "ct": "court", "pl": "place", "hwy": "highway", "pkwy": "parkway", "sq": "square", "ter": "terrace", "cir": "circle",
    "trl": "trail", "wy": "way", "ste": "suite", "fl": "floor", "apt": "apartment", "bldg": "building", "n": "north", "s": "south", "e": "east",
    "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "mg": "marg", "nr": "near", "opp": "opposite",
}
STREET_TYPES_FR = frozenset("rue boulevard avenue place chemin route impasse allee square faubourg cours quai passage sentier residence lotissement zone promenade esplanade montee hameau villa cite porte voie rond parvis galerie chaussee clos domaine lieu mail sente venelle".split())
STREET_TYPES_EN = frozenset("street road avenue boulevard drive lane court place highway parkway square terrace circle trail way marg nagar colony sector layout main cross block phase gali chowk bazar bazaar market complex plaza tower towers mall estate".split())
UNIT_WORDS = frozenset("suite floor apartment building unit room bat batiment etage appt porte bureau lot escalier esc no num numero flat shop office".split())
STOP_WORDS = frozenset("de du des la le les l d et a au aux en sur sous the of and at on in near opposite behind next to cedex bp cs france".split())
LEGAL_FORMS = frozenset("sa sas sasu sarl eurl sci snc scp scm selarl selas ei eirl earl gaec sca scop scea sel ste societe ets etablissements cie compagnie gie association asso llc inc ltd limited pvt private co corp corporation company llp pc plc lp pllc incorporated gmbh srl bv nv ag".split())
ORDINALS = frozenset("bis ter quater b t".split())
# Regions and departments of France, which say nothing about a street.
FR_REGIONS = (
    "auvergne rhone alpes", "bourgogne franche comte", "centre val de loire", "provence alpes cote d azur", "nouvelle aquitaine", "hauts de france", "ile de france", "pays de la loire",
    "grand est", "champagne ardenne", "languedoc roussillon", "midi pyrenees", "nord pas de calais", "basse normandie", "haute normandie", "poitou charentes", "rhone alpes", "franche comte",
    "alpes de haute provence", "hautes alpes", "alpes maritimes", "bouches du rhone", "charente maritime", "corse du sud", "haute corse", "cote d or", "cotes d armor", "eure et loir",
    "haute garonne", "ille et vilaine", "indre et loire", "loir et cher", "haute loire", "loire atlantique", "lot et garonne", "maine et loire", "haute marne", "meurthe et moselle",
    "puy de dome", "pyrenees atlantiques", "hautes pyrenees", "pyrenees orientales", "bas rhin", "haut rhin", "haute saone", "saone et loire", "haute savoie", "seine maritime",
    "seine et marne", "deux sevres", "tarn et garonne", "haute vienne", "territoire de belfort", "hauts de seine", "seine saint denis", "val de marne", "val d oise", "la reunion",
    "bretagne", "normandie", "occitanie", "corse", "alsace", "aquitaine", "auvergne", "bourgogne", "limousin", "lorraine", "picardie", "paca", "idf", "aisne", "allier", "ardeche", "ardennes",
    "ariege", "aube", "aude", "aveyron", "calvados", "cantal", "charente", "correze", "creuse", "dordogne", "doubs", "drome", "finistere", "gers", "gironde", "herault", "indre", "isere",
    "landes", "loiret", "lozere", "mayenne", "morbihan", "moselle", "nievre", "oise", "orne", "sarthe", "savoie", "somme", "tarn", "vaucluse", "vendee", "vosges", "yonne", "essonne",
    "yvelines", "guadeloupe", "martinique", "guyane", "mayotte",
)

# Patterns of raw text: a phone number, the tail of a URL behind other text, a form of address before a name,
# adjacent repeats of up to three words, and street numbers.
PHONE = rf"(?U)(?<!\d)\d{{{PHONE_DIGITS},}}(?!\d)"
PHONE_WITH_SIGNS = rf"(?U)(?:\s*[-–—|:,/]\s*)?(?<!\d)\+?\d{{{PHONE_DIGITS},}}(?!\d)"
URL_TAIL = r"(?iU)(?<=\w)[\s|,;:\-–—]*(?:https?://|www\.)[^\s|,;]+"
MESSRS = r"^\s*(?:m\s*/\s*s|messrs)\b\.?\s*"
REPEATS = r"\b(\w+(?: \w+){0,2})(?: \1\b)+"
STREET_NUMBERS = (r"^(\d{1,6}[a-z]?)\b", r"\b(?:no|plot|shop|house|flat|door|unit|bldg|ste|apt|h)\s?(\d{1,6}[a-z]?)\b")

# Letters of scripts that are written by the sound their Unicode name begins with, but for these names.
LETTER_SOUNDS = {
    "YERU": "y", "IE": "e", "IO": "yo", "YU": "yu", "YA": "ya", "HARD": "", "SOFT": "", "SHORT": "y", "EL": "l", "EM": "m", "EN": "n", "ER": "r", "ES": "s", "EF": "f", "HA": "kh", "SHCHA": "shch",
    "UKRAINIAN": "ye", "BYELORUSSIAN-UKRAINIAN": "i", "YI": "yi", "ETA": "i", "OMEGA": "o", "OMICRON": "o", "UPSILON": "y", "EPSILON": "e", "FINAL": "s", "CHI": "ch", "XI": "x", "PSI": "ps",
    "AIN": "", "ALEF": "a", "HAMZA": "", "TEH": "t", "YEH": "y", "WAW": "w", "HEH": "h", "HAH": "h", "AYIN": "", "VAV": "v", "YOD": "y",
}
