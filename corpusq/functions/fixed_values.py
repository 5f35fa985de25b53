"""Fixed values.

Everything in this module is a value that the results depend on (word lists,
lookup tables, patterns, weights, limits).  Nothing here is logic.  Every
operator takes its list as a parameter, so any of them can be replaced.
"""

# --- fixed values: text cleaning patterns, in order of application -----------
NAV_MARKER = r"<<\s*([^>]+?)\s+(\d+)"
TAG = r"<[^>]+>"
PAGE_REFERENCES = [
    r"\(see\s+\*\*[^*]+\*\*,\s*p\.\s*\d+\)",
    r"\([pP]\.\s*\d+\)",
    r"\*\*[pP]\.\s*\d+\*\*",
    r"[pP]age\s+\d+",
]
IMAGE_REFERENCE = r"!\[\]\([^)]+\.(jpeg|jpg|png|gif|bmp)\)"
BREADCRUMB_LINE = r"^\s*\d+\s+[\w\s]+\s*>>\s*$"
ESCAPED_CROSS_REFERENCE = r"\*\s*\\\*\s*See\s+[^,]+,\s*p\.\s*\d+\*"
BOLD_PAGE_REFERENCE = r"\*\*[^*]+\*\*,\s*p\.\s*\d+\.?"
QUOTE_ONLY_LINE = r"^\s*>\s*$"
SIMPLE_PAGE_REFERENCE = r"\(see\s+p\.\s*\d+\)\.?"

# --- fixed values: mojibake repairs, in order of application -----------------
MOJIBAKE = [
    ('Ã¢â‚¬"', "—"),
    ("Ã¢â‚¬â„¢", "'"),
    ('Ã¢â‚¬Å"', '"'),
    ("Ã¢â‚¬", '"'),
    ("Ã¢â‚¬Â¢", "•"),
    ("Ã¢â€ ", "→"),
    ("Ã¢â‚¬Ëœ", "'"),
    ("Ã¢â‚¬Â¦", "..."),
    ("Ã¢Ë†", "-"),
    ("Ã‚ ", " "),
]

# --- fixed values: title normalisation ---------------------------------------
TITLE_VARIATIONS = {
    "SKILLS": "Skills",
    "SOCIAL SKILLS": "Social Skills",
    "THE MATRIX": "The Matrix",
    "MATRIX BASICS": "Matrix Basics",
    "WIRELESS WORLD": "Wireless World",
    "CRACKING THE MATRIX SPINE": "Cracking The Matrix Spine",
    "TECHNOMANCERS": "Technomancers",
    "(MIS)USING THE MATRIX": "(Mis)Using The Matrix",
    "PROGRAMS": "Programs",
    "HOSTS": "Hosts",
}
TITLE_SPECIAL_CASES = {
    "THE MATRIX": "The Matrix",
    "PANS AND WANS": "PANs and WANs",
    "IC": "IC",
    "MATRIX BASICS": "Matrix Basics",
    "WIRELESS WORLD": "Wireless World",
}
ROMAN_NUMERALS = ["II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
CAPITALISED_SHORT_WORDS = ["AND", "THE", "FOR", "WITH"]
FILE_SECTION_HINTS = [("11", "Street Gear"), ("street", "Street Gear"), ("gear", "Street Gear")]

# --- fixed values: documents worth scanning for library records --------------
RULEBOOK_INDICATORS = [
    'document_type: "rulebook"', "core rulebook", "skill", "quality", "gear",
    "weapon", "armor", "chapter", "dice pool", "attribute",
]
RULEBOOK_MIN_CHARS = 1000

DESCRIPTION_LINES, DESCRIPTION_CHARS = 3, 200

# --- fixed values: chunking ---------------------------------------------------
CHUNK_SIZE, CHUNK_OVERLAP = 1200, 200
SEMANTIC_CHUNK_SIZE, SEMANTIC_OVERLAP, SEMANTIC_MIN_CHUNK = 800, 150, 200
TABLE_ROWS_PER_CHUNK = 10
DETECT_STAT_WORDS = ["acc", "damage", "mode", "ammo", "avail", "cost"]
BLOCK_STAT_WORDS = ["acc", "damage", "mode", "ammo"]
TABLE_HEADER_WORDS = ["weapon", "acc", "damage", "name"]
TABLE_SECTION_WORDS = ["WEAPON", "FIREARM", "GEAR"]
TABLE_STAT_WORDS = ["acc", "damage", "ap", "mode", "rc", "ammo", "avail", "cost"]
RULE_TERMS = ["dice pool", "test:", "modifier", "resistance"]
EXAMPLE_TERMS = ["example", "for instance", "suppose"]
SEMANTIC_BOUNDARIES = [
    r"#{1,6}\s+.+",
    r"\|\s*(?:WEAPON|FIREARM|GEAR|ITEM|NAME)\s*\|.*\|",
    r"[A-Z][A-Z\s&]{10,}",
    r"\d+\.\s+[A-Z].+",
]

# --- fixed values: section scoring lexicon (category, group, term, weight) ----
SECTION_LEXICON = [
    ("Gear", "manufacturers", "ares", 0.2),
    ("Gear", "manufacturers", "colt", 0.2),
    ("Gear", "manufacturers", "ruger", 0.2),
    ("Gear", "manufacturers", "browning", 0.2),
    ("Gear", "weapon_types", "pistol", 0.15),
    ("Gear", "weapon_types", "rifle", 0.15),
    ("Gear", "weapon_types", "shotgun", 0.15),
    ("Gear", "specific_weapons", "predator", 0.25),
    ("Gear", "specific_weapons", "government 2066", 0.25),
    ("Matrix", "ic_programs", "black ic", 0.2),
    ("Matrix", "ic_programs", "white ic", 0.2),
    ("Matrix", "matrix_damage", "matrix damage", 0.2),
    ("Matrix", "matrix_damage", "biofeedback", 0.2),
    ("Magic", "specific_spells", "fireball", 0.3),
    ("Magic", "specific_spells", "manabolt", 0.3),
    ("Magic", "magic_skills", "spellcasting", 0.25),
    ("Magic", "magic_skills", "summoning", 0.25),
]
SECTION_PATTERNS = [
    ("Gear", r"\d+P\s*(?:\(f\))?", 0.2),
    ("Gear", r"AP\s*-\d+", 0.2),
    ("Gear", r"\d+S\s*\(e\)", 0.2),
]
SECTION_ORDER = ["Gear", "Matrix", "Magic"]
SECTION_OVERRIDE_LIMITS = {"Gear": 0.5, "Matrix": 0.4, "Magic": 0.4}
LABEL_REQUIRED_FIELDS = ["primary_section", "content_type", "contains_rules"]

# --- fixed values: detectors ---------------------------------------------------
SPELL_NAMES = [
    "fireball", "manabolt", "lightning bolt", "death touch", "manaball",
    "flamethrower", "ball lightning", "shatter", "powerbolt", "powerball",
    "knockout", "stunbolt", "stunball", "levitate", "magic fingers", "armor",
    "control actions", "mob control", "control thoughts", "mob mind", "fling",
    "ice sheet", "light", "mana barrier", "physical barrier", "clairvoyance",
    "detect magic", "detect life", "analyze truth", "mind probe",
    "combat sense", "danger sense", "enhanced senses", "invisibility",
    "improved invisibility", "silence", "confusion", "chaos", "entertainment",
    "mass confusion", "phantasm", "trid phantasm", "heal",
    "increase reflexes", "increase attribute", "decrease attribute",
    "antidote", "cure disease", "stabilize", "oxygenate",
]
SPELL_FORMATS = [
    r"\*\*Type:\*\*\s*[MP]\s*;\s*\*\*Range:\*\*",
    r"\*\*Drain:\*\*\s*F\s*[-—–]\s*\d+",
    r"\*\*Duration:\*\*\s*[ISPA]",
    r"Type:\s*[MP]\s*Range:\s*\w+",
    r"Drain:\s*F[-—–]\d+",
]
SPELL_MECHANICS = [
    "force", "drain", "range", "duration", "type", "spellcasting + magic",
    "drain resistance", "astral", "physical", "mana", "net hits",
    "spellcasting test", "magic rating", "threshold", "hits scored",
    "opposed test", "willpower + logic", "body + willpower", "sustained",
    "instantaneous", "permanent", "special", "line of sight", "touch",
    "area effect", "direct spell", "indirect spell",
]
SPELL_CONTEXT = [
    "magician", "mage", "shaman", "adept", "mystic adept", "awakened",
    "magic rating", "spell formula", "reagents", "foci", "focus",
    "tradition", "mentor spirit", "astral space", "astral projection",
    "magical lodge", "background count", "mana", "essence",
]
IC_NAMES = [
    "acid", "binder", "black ic", "blaster", "crash", "jammer", "killer",
    "marker", "patrol", "probe", "scramble", "grey ic", "gray ic",
    "white ic", "red ic", "blue ic",
]
IC_ATTACKS = [
    r"\*\*Attack:\*\*.*?v\.",
    r"Attack:\s*Host\s*Rating\s*x\s*2",
    r"Host\s*Rating\s*x\s*2\s*\[Attack\]",
    r"v\.\s*\w+\s*\+\s*\w+",
    r"causes.*?DV.*?damage",
    r"reduces?\s*your\s*\w+\s*by\s*\d+",
]
IC_ATTRIBUTES = [
    "attack", "sleaze", "data processing", "firewall", "device rating",
    "host rating", "matrix damage", "biofeedback", "dumpshock", "link-lock",
    "bricking", "marks", "overwatch score",
]
IC_CONTEXT = [
    "decker", "hacker", "technomancer", "spider", "agent", "sprite", "host",
    "node", "grid", "matrix", "virtual reality", "augmented reality",
    "persona", "icon", "file", "program", "utility", "cybercombat",
]
WEAPON_MAKERS = [
    "ares", "colt", "ruger", "browning", "remington", "defiance", "yamaha",
    "fichetti", "beretta", "taurus", "steyr", "enfield", "cavalier arms",
    "ranger arms", "pjss", "parashield", "ak-97", "mossberg", "winchester",
    "hk", "heckler koch", "fn", "sig sauer",
]
WEAPON_NAMES = [
    "predator", "ares predator", "government 2066", "ultra-power",
    "roomsweeper", "super warhawk", "crusader", "black scorpion", "ak-97",
    "ares alpha", "desert strike", "crockett", "ranger sm-5",
    "fichetti security 600", "browning ultra-power", "colt government",
    "ruger super warhawk", "defiance t-250", "mossberg am-cmdt",
]
WEAPON_TABLES = [
    r"\|\s*(?:WEAPON|FIREARM|ACC|Accuracy|Damage|AP|Mode|RC|Ammo|Avail|Cost)\s*\|",
    r"\|\s*\w+\s*\|\s*\d+(?:\s*\(\d+\))?\s*\|\s*\d+[PS]",
    r"Acc\s*Damage\s*AP\s*Mode\s*RC\s*Ammo\s*Avail\s*Cost",
]
WEAPON_CATEGORIES = [
    "LIGHT PISTOLS", "HEAVY PISTOLS", "MACHINE PISTOLS", "SUBMACHINE GUNS",
    "ASSAULT RIFLES", "SNIPER RIFLES", "SHOTGUNS", "SPECIAL WEAPONS",
]
SPELL_CATEGORIES = [
    ("Combat", ["bolt", "ball", "touch", "shatter"]),
    ("Detection", ["detect", "analyze", "sense"]),
    ("Manipulation", ["control", "levitate", "fingers", "armor"]),
    ("Environmental", ["barrier", "light", "sheet"]),
    ("Health", ["heal", "cure", "increase", "decrease"]),
]

# --- fixed values: record patterns ---------------------------------------------
WEAPON_ACCURACY = r"\d+(?:\s*\(\d+\))?"
WEAPON_DAMAGE = r"\d+[PS](?:\s*\([^)]+\))?"
LABELLED_TEXT = r"\*\*([^:]+?):\*\*\s*([^*]+?)(?=\*\*|$)"
SPELL_RECORD = r"([A-Z][A-Z\s]+?)\s*(?:\([^)]+\))?\s*\*\*Type:\*\*\s*([MP])\s*;\s*\*\*Range:\*\*\s*([^;]+?)\s*;(?:\s*\*\*Damage:\*\*\s*([^;]+?)\s*;)?\s*\*\*Duration:\*\*\s*([^;]+?)\s*;\s*\*\*Drain:\*\*\s*([^\n]+)"
IC_RECORD = r"([A-Z][A-Z\s]+?)\s*\*\*Attack:\*\*\s*([^v]+?)\s*v\.\s*([^\n]+)"
FIRING_MODES = [
    ("burst", r"\bburst\s*(?:fire|mode)?\b"),
    ("semi-auto", r"\bsemi[-\s]*auto(?:matic)?\b"),
    ("full auto", r"\bfull[-\s]*auto(?:matic)?\b"),
    ("single shot", r"\bsingle[-\s]*shot\b"),
]
MODE_ALIASES = [
    ("burst", ["BF", "BURST"]),
    ("burst fire", ["BF", "BURST"]),
    ("semi-auto", ["SA", "SEMI"]),
    ("semi-automatic", ["SA", "SEMI"]),
    ("full auto", ["FA", "FULL"]),
    ("full automatic", ["FA", "FULL"]),
    ("single shot", ["SS", "SINGLE"]),
]
QUERY_ENTITY_PATTERNS = [
    ("weapon", r"\b(ares|colt|ruger|browning|remington)\s+[\w\s-]+", 0.8),
    ("weapon", r"\b[\w\s-]*(?:pistol|rifle|shotgun|smg)\b", 0.8),
    ("weapon", r"\bpredator\b|\bgovernment\b|\bultra-power\b", 0.8),
    ("spell", r"\b(fireball|manabolt|lightning\s+bolt|death\s+touch)\b", 0.7),
    ("spell", r"\b[\w\s]+(?:bolt|ball|touch|barrier)\b", 0.7),
    ("spell", r"\bspell\b|\bmagic\b|\bdrain\b", 0.7),
    ("ic", r"\b(black\s+ic|blaster|acid|binder|killer)\b", 0.7),
    ("ic", r"\b[\w\s]*\s+ic\b", 0.7),
    ("ic", r"\bhost\b|\bmatrix\b|\bhacking\b", 0.7),
]
NOISE_WORDS = ["the", "a", "an", "with", "using", "in", "on", "at"]

# --- fixed values: reference libraries ------------------------------------------
SKILL_PATTERNS = [
    r"\|\s*([A-Z][a-zA-Z\s&\(\)]+?)\s*\|\s*([A-Z][a-z]{2,3})\s*\|\s*([A-Z][a-zA-Z\s]*)\s*\|",
    r"^[\s\-\*]\s*([A-Z][a-zA-Z\s&\(\)]+?)\s*\(([A-Z][a-z]{2,3})\)",
    r"^#+\s*([A-Z][a-zA-Z\s&\(\)]+?)(?:\s*\(([A-Z][a-z]{2,3})\))?",
]
QUALITY_PATTERNS = [
    r"^#+\s*([A-Z][a-zA-Z\s\(\)]+?)(?:\s*[\(\[]([0-9\-]+)[\)\]])?",
    r"\|\s*([A-Z][a-zA-Z\s\(\)]+?)\s*\|\s*([0-9\-]+)?\s*\|\s*(Positive|Negative|pos|neg)?\s*\|",
    r"^[\s\-\*]\s*([A-Z][a-zA-Z\s\(\)]+?)\s*[\[\(]([0-9\-]+)[\]\)]",
]
GEAR_PATTERNS = [
    r"\|\s*([A-Z][a-zA-Z\s\(\)\-,&]+?)\s*\|\s*([0-9,¥]+)?\s*\|\s*([0-9]+[RF]?)?\s*\|\s*([^\|]*?)\s*\|",
    r"^[\s\-\*]\s*([A-Z][a-zA-Z\s\(\)\-,&]+?)\s*[\(\[]([0-9,¥]+)?\s*,?\s*([0-9]+[RF]?)?\s*[\)\]]",
]
SKILL_STOP_NAMES = ["skill", "name", "attribute"]
QUALITY_STOP_NAMES = ["quality", "name", "cost", "type"]
GEAR_STOP_NAMES = ["item", "name", "cost", "gear", "equipment"]
KNOWLEDGE_SECTION_WORDS = ["knowledge", "academic", "street", "professional"]
LANGUAGE_SECTION_WORDS = ["language"]
NEGATIVE_SECTION_WORDS = ["negative", "flaw", "disadvantage"]
PAGE_MENTIONS = [r"p\.\s*([0-9]+)", r"page\s*([0-9]+)", r"SR[56]?\s*([0-9]+)"]
ARMOR_VALUES = [r"armor\s*([0-9]+)", r"\+([0-9]+)\s*armor", r"protection\s*([0-9]+)"]
RATING_RANGES = [
    r"rating\s*([0-9]+[\-–][0-9]+)",
    r"rating\s*([0-9]+)",
    r"\(rating\s*([0-9]+[\-–][0-9]+)\)",
    r"levels?\s*([0-9]+[\-–][0-9]+)",
]
QUALITY_RATING = r"rating\s*([0-9]+[\-–][0-9]+|[0-9]+)"
SKILL_GROUPS = [
    ("acting", ["con", "impersonation", "performance"]),
    ("athletics", ["gymnastics", "running", "swimming"]),
    ("biotech", ["cybertechnology", "first_aid", "medicine"]),
    ("close_combat", ["blades", "clubs", "unarmed_combat"]),
    ("conjuring", ["banishing", "binding", "summoning"]),
    ("cracking", ["cybercombat", "electronic_warfare", "hacking"]),
    ("electronics", ["computer", "hardware", "software"]),
    ("enchanting", ["alchemy", "artificing", "disenchanting"]),
    ("engineering", ["aeronautics_mechanics", "automotive_mechanics", "industrial_mechanics"]),
    ("firearms", ["archery", "automatics", "longarms", "pistols"]),
    ("influence", ["etiquette", "leadership", "negotiation"]),
    ("outdoors", ["navigation", "survival", "tracking"]),
    ("perception", ["assensing", "perception"]),
    ("sorcery", ["counterspelling", "ritual_spellcasting", "spellcasting"]),
    ("stealth", ["disguise", "infiltration", "palming"]),
    ("tasking", ["compiling", "decompiling", "registering"]),
]
ATTRIBUTE_ABBREVIATIONS = {
    "bod": "body", "agi": "agility", "rea": "reaction", "str": "strength",
    "wil": "willpower", "log": "logic", "int": "intuition", "cha": "charisma",
    "edg": "edge", "mag": "magic", "res": "resonance",
}
GEAR_CATEGORIES = [
    ("weapons", ["weapon", "melee", "firearm", "gun", "blade", "club"]),
    ("clothing_armor", ["armor", "clothing", "protection"]),
    ("electronics", ["electronics", "commlink", "cyberdeck", "program"]),
    ("cyberware_bioware", ["cyberware", "bioware", "augment", "implant"]),
    ("vehicles", ["vehicle", "car", "bike", "truck"]),
    ("drones", ["drone", "pilot", "sensor"]),
    ("tools", ["tool", "kit", "equipment"]),
]
GEAR_SUBCATEGORIES = [
    ("melee", ["melee"]),
    ("ranged", ["ranged", "firearm", "gun", "pistol", "rifle"]),
    ("commlinks", ["commlink"]),
    ("cyberdecks", ["cyberdeck"]),
    ("programs", ["program"]),
]

# --- fixed values: queries --------------------------------------------------------
ROLE_SECTIONS = {
    "decker": "Matrix", "hacker": "Matrix", "mage": "Magic", "adept": "Magic",
    "street_samurai": "Combat", "rigger": "Riggers", "technomancer": "Matrix",
    "face": "Social",
}
TITLE_SECTIONS = [
    ("Matrix", ["matrix", "hacking", "cyberdeck", "icon", "host", "data", "program", "decker", "technomancer"]),
    ("Combat", ["combat", "weapon", "armor", "damage", "initiative", "attack", "defense", "firearm", "melee"]),
    ("Magic", ["magic", "spell", "conjuring", "enchanting", "astral", "mana", "spirit", "adept", "mage", "shaman"]),
    ("Riggers", ["rigger", "drone", "vehicle", "pilot", "sensor", "autosofts", "jumped"]),
    ("Social", ["social", "contact", "etiquette", "leadership", "negotiation", "street cred"]),
    ("Skills", ["skill", "attribute", "test", "specialization", "knowledge"]),
    ("Character Creation", ["character", "creation", "priority", "metatype", "attribute", "quality", "background"]),
]
QUERY_CATEGORIES = [
    ("damage_resistance", ["damage", "resistance", "resist", "soak", "armor", "condition monitor",
                           "physical damage", "stun damage", "overflow", "wound modifier", "dice pool"]),
    ("matrix", ["matrix", "hack", "cyberdeck", "decker", "firewall", "attack", "sleaze", "data processing",
                "ic", "host", "biofeedback", "dumpshock", "overwatch", "device rating", "matrix damage",
                "silent running", "marks", "black ic"]),
    ("magic", ["spell", "magic", "drain", "force", "mana", "astral", "summoning", "spirit", "adept",
               "mage", "enchanting", "focus", "reagents"]),
    ("combat", ["combat", "initiative", "action phase", "attack", "defense", "cover", "melee", "ranged",
                "full auto", "burst fire", "called shot", "reach"]),
    ("dice_pools", ["dice pool", "dice", "roll", "attribute", "skill", "threshold", "modifier", "bonus",
                    "penalty", "glitch", "test"]),
]
CATEGORY_EXPANSIONS = {
    "damage_resistance": "Device Rating Firewall damage resistance soak armor condition monitor",
    "matrix": "matrix cyberdeck firewall biofeedback decker attack sleaze data processing",
    "magic": "spell drain force mana magic astral summoning spirit",
    "combat": "initiative combat attack defense armor penetration melee ranged",
    "dice_pools": "attribute skill dice pool threshold modifier test roll",
}
CATEGORY_BOOSTS = {
    "damage_resistance": ["Device Rating + Firewall", "Willpower + Firewall", "Body + Armor"],
    "matrix": ["Device Rating + Firewall", "Willpower + Firewall", "biofeedback", "matrix damage"],
    "dice_pools": ["Attribute + Skill", "dice pool", "threshold", "net hits"],
    "combat": ["Initiative", "Defense", "armor penetration", "damage code"],
    "magic": ["Drain Value", "Force", "Magic + Skill", "astral plane"],
}
INTENT_TERMS = [
    ("weapon", ["ares", "colt", "ruger", "browning", "pistol", "rifle", "shotgun", "predator", "government 2066"]),
    ("matrix", ["black ic", "white ic", "matrix damage", "biofeedback"]),
    ("magic", ["fireball", "manabolt", "spellcasting", "summoning"]),
    ("rigger", []),
    ("combat", []),
    ("skills", []),
    ("character_creation", []),
    ("social", []),
]
INTENT_SECTIONS = {
    "weapon": "Gear", "matrix": "Matrix", "magic": "Magic", "rigger": "Riggers", "combat": "Combat",
    "skills": "Skills", "character_creation": "Character_Creation", "social": "Social",
}
INTENT_BOOSTS = {
    "weapon": ["weapon", "damage", "accuracy", "cost"],
    "matrix": ["matrix", "hacking", "cyberdeck", "ic"],
    "magic": ["spell", "magic", "force", "drain"],
    "rigger": ["drone", "vehicle", "rigger", "pilot"],
    "combat": ["combat", "initiative", "damage", "test"],
    "skills": ["skill", "dice pool", "test", "threshold"],
    "character_creation": ["priority", "attribute", "metatype", "karma"],
    "social": ["contact", "etiquette", "negotiation", "loyalty"],
}
QUERY_TYPES = [
    ("stats_lookup", ["stats", "statistics", "details", "information about", "tell me about"]),
    ("comparison", ["vs", "versus", "compare", "better than", "difference between"]),
    ("rules_question", ["how to", "rules for", "how does", "can i", "is it possible"]),
    ("cost_availability", ["cost", "price", "how much", "availability", "where to buy"]),
]
TABLE_QUERY_WORDS = ["table", "list", "stats"]
RULE_QUERY_WORDS = ["rule", "mechanic", "how to"]
CLEAR_QUERY_PHRASES = ["what is", "how to", "tell me about"]
ENTITY_SYNONYMS = {
    "pistol": "sidearm", "handgun": "sidearm", "rifle": "longarm", "assault rifle": "longarm",
    "shotgun": "scattergun", "hacking": "cybercombat", "matrix": "cybercombat", "cyberdeck": "deck",
    "spell": "magical", "magic": "magical", "summoning": "spirit",
}

# --- fixed values: corpus analytics -------------------------------------------------
SIZE_BINS = [
    ("very_small (0-100)", 0, 100), ("small (100-300)", 100, 300), ("medium (300-600)", 300, 600),
    ("large (600-1000)", 600, 1000), ("very_large (1000+)", 1000, None),
]
CONTEXT_WORDS = ["test", "roll", "dice", "attribute", "skill", "character", "damage", "armor"]
ANALYSIS_EXAMPLES = ["example:", "for example", "e.g.", "suppose", "let's say", "imagine"]
ANALYSIS_RULES = ["test:", "dice pool:", "threshold:", "modifier:", "when a character", "roll", "add", "subtract"]
CROSS_REFERENCE = r"see page \d+|see chapter \d+|refer to|as described in"
EXPECTED_FIELDS = ["primary_section", "document_type", "edition", "source"]
TOPIC_WORDS = ["taser", "stun", "electrical", "electricity", "shock"]
TOPIC_PAIR_WORDS = ["damage", "resist", "soak", "dice pool", "body", "armor"]
TOPIC_PAIR_MARKERS = ["electric", "stun"]
KEYWORD_GROUPS = [
    ("combat", ["initiative", "damage", "armor", "weapon", "attack", "defense", "combat", "melee", "ranged",
                "firearms", "body + armor", "wound", "stun", "physical damage"]),
    ("magic", ["spell", "magic", "mage", "astral", "spirit", "summoning", "drain", "force", "tradition",
               "adept", "enchanting"]),
    ("matrix", ["matrix", "hacking", "decker", "cyberdeck", "program", "ic", "host", "firewall",
                "data processing", "attack rating", "sleaze"]),
]
RECOMMENDATIONS = {
    "uneven_sizes": "HIGH PRIORITY: Chunk sizes are highly inconsistent - implement adaptive chunking",
    "concentrated_classes": "HIGH PRIORITY: Classification is over-concentrated in few categories - improve multi-label classification",
    "too_many_examples": "MEDIUM PRIORITY: Too many example-only chunks - separate examples from rules with metadata flags",
    "mid_sentence": "HIGH PRIORITY: >10% of chunks split mid-sentence - implement sentence-aware chunking",
    "topic_examples": "CRITICAL: Query-relevant chunks are mostly examples, not explicit rules - implement rule vs example tagging",
    "boundary_high": "HIGH PRIORITY: >20% chunks have poor boundaries - review chunking parameters",
    "boundary_medium": "MEDIUM PRIORITY: Some boundary issues detected - monitor chunking quality",
    "boundary_good": "GOOD: Chunk boundaries are well-formed",
}

# --- fixed values: structured records -------------------------------------------------
POOL_QUERY_GATE = ["dice", "roll", "pool", "test", "check"]
POOL_TESTS = [
    ("hacking", "logic", "hacking"),
    ("shooting", "agility", "pistols"),
    ("perception", "intuition", "perception"),
    ("stealth", "agility", "infiltration"),
    ("social", "charisma", "con"),
    ("athletics", "agility", "gymnastics"),
    ("first aid", "logic", "first aid"),
    ("driving", "reaction", "pilot ground craft"),
]
STAT_DEFAULTS = {
    "body": 1, "agility": 1, "reaction": 1, "strength": 1, "charisma": 1, "logic": 1, "intuition": 1,
    "willpower": 1, "edge": 1, "essence": 6.0, "initiative": 0,
}
JOB_RETENTION_SECONDS = 300
HISTORY_EXCHANGES, HISTORY_TOKENS, HISTORY_LINES = 3, 1500, 12
NOTHING_FOUND = "No relevant information found in the indexed documents. Try adjusting your filters or search terms."
