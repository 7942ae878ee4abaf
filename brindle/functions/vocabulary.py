"""Word lists, codes, patterns and settings that results depend on."""

STOP_WORDS = (
    "the and for are but not you all can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use"
).split()
#: English function words that full-text search leaves out where it is asked to.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
KEY_TERM_STOP_WORDS = "the and or but in on at to for".split()
#: Fixed values of the published English suffix rules (Porter's second algorithm): words that have their own stem, words that stay, words
#: that stay after the first step, beginnings after which the first region starts, and per step ending -> replacement.
STEM_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STEM_STAYS = "inning outing canning herring earring proceed exceed succeed".split()
STEM_BEGINNINGS = "gener commun arsen".split()
STEM_DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
STEM_LI = "cdeghkmnrt"
STEM_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEM_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEM_STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
QUESTION_WORDS = "what where when who why how which whose".split()
MEDICAL_TERMS = "adverse efficacy safety dosage administration hemoglobin creatinine laboratory clinical trial".split()
SYNONYMS = {
    "adverse event": ["ae", "side effect", "adverse reaction"],
    "treatment": ["therapy", "medication", "drug", "intervention"],
    "laboratory": ["lab", "test", "measurement", "assay"],
    "efficacy": ["effectiveness", "outcome", "response"],
    "safety": ["tolerability", "toxicity", "adverse events"],
}
SDTM_DOMAINS = "DM AE CM DA DS DV EX FA IE IN MH MO PE PR QS SC SU TA TE TI TR TV VS".split()
ADAM_DATASETS = "ADSL ADAE ADCM ADDA ADDS ADLB ADMB ADMH ADPC ADPE ADRG ADRS ADTE ADTI ADTR ADVS ADYD".split()
STUDY_ID_PATTERNS = [r"STUDY(\d{4,6})", r"STUDYID[_-]?(\w+)", r"STUDY[_-]?(\w+)", r"PROTOCOL[_-]?(\w+)"]
#: In order: earlier patterns win where they overlap.
PHI_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("Phone", r"\b\d{3}-\d{3}-\d{4}\b"),
    ("Medical Record", r"\b[A-Z]{2}\d{4}\b"),
    ("Date", r"\b\d{2}/\d{2}/\d{4}\b"),
    ("Date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("Name", r"\b[A-Za-z]+,\s*[A-Za-z]+\b"),
]
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
IDENTIFIER_PATTERN = r"\b[A-Z]{2}\d{4}\b"
DOMAIN_CODE_PATTERN = r"\b(?:trt|ae|lb)\d*\b"
#: Basic entity patterns: group 1 names the entity; matched without regard to case.
ENTITY_PATTERNS = {
    "subject": [r"subject\s+(\w+)", r"patient\s+(\w+)", r"participant\s+(\w+)", r"usubjid\s*=\s*['\"]?(\w+)['\"]?"],
    "treatment": [r"treatment\s+(\w+)", r"drug\s+(\w+)", r"medication\s+(\w+)", r"trtd[a-z]*\s*=\s*['\"]?(\w+)['\"]?"],
    "lab_test": [r"lab\s+(\w+)", r"test\s+(\w+)", r"lb[a-z]*\s*=\s*['\"]?(\w+)['\"]?", r"parameter\s+(\w+)"],
    "adverse_event": [r"adverse\s+event\s+(\w+)", r"ae[a-z]*\s*=\s*['\"]?(\w+)['\"]?", r"event\s+(\w+)"],
    "medication": [r"medication\s+(\w+)", r"cm[a-z]*\s*=\s*['\"]?(\w+)['\"]?", r"concomitant\s+(\w+)"],
    "study": [r"study\s+(\w+)", r"protocol\s+(\w+)", r"trial\s+(\w+)"],
    "domain": [r"domain\s+(\w+)", r"sdtm\s+(\w+)", r"adam\s+(\w+)"],
}
RELATION_PATTERNS = [
    ("received", r"(\w+)\s+(?:received|took|was\s+given)\s+(\w+)"),
    ("experienced", r"(\w+)\s+(?:had|experienced|reported)\s+(\w+)"),
    ("showed", r"(\w+)\s+(?:showed|demonstrated)\s+(\w+)"),
    ("treated_with", r"(\w+)\s+(?:treated\s+with|managed\s+with)\s+(\w+)"),
    ("associated_with", r"(\w+)\s+(?:associated\s+with|linked\s+to)\s+(\w+)"),
    ("derived_from", r"(\w+)\s+(?:derived\s+from|based\s+on)\s+(\w+)"),
]
#: Advanced entity patterns: (pattern, group that names the entity).
ADVANCED_ENTITY_PATTERNS = {
    "subject": [(r"\b(?:subject|patient|participant)\s+[A-Z]{2}\d{4}\b", 0), (r"\busubjid\s*=\s*['\"]?([A-Z]{2}\d{4})['\"]?\b", 1), (r"\bsubject\s*#?\s*(\w+)\b", 1)],
    "treatment": [
        (r"\b(?:treatment|drug|medication|therapy)\s+([A-Za-z0-9\s-]+?)(?:\s|$)", 1), (r"\btrt[a-z]*\s*=\s*['\"]?([^'\"\n]+)['\"]?\b", 1),
        (r"\b(?:received|took|was\s+given)\s+([A-Za-z0-9\s-]+?)(?:\s|$)", 1),
    ],
    "lab_test": [
        (r"\b(?:lab|test|parameter|measurement)\s+([A-Za-z0-9\s_\-]+?)(?:\s|$)", 1), (r"\blb[a-z]*\s*=\s*['\"]?([^'\"\n]+)['\"]?\b", 1),
        (r"\b(?:hemoglobin|creatinine|alt|ast|wbc|rbc)\b", 0),
    ],
    "adverse_event": [
        (r"\b(?:adverse\s+event|ae|side\s+effect)\s*:?\s*([A-Za-z0-9\s_\-]+?)(?:\s|$|\n)", 1), (r"\bae[a-z]*\s*=\s*['\"]?([^'\"\n]+)['\"]?\b", 1),
        (r"\b(?:headache|nausea|vomiting|dizziness|fatigue)\b", 0),
    ],
    "medication": [(r"\b(?:concomitant|background)\s+(?:medication|drug)\s+([A-Za-z0-9\s-]+?)(?:\s|$)", 1), (r"\bcm[a-z]*\s*=\s*['\"]?([^'\"\n]+)['\"]?\b", 1)],
    "study": [(r"\b(?:study|protocol|trial)\s+([A-Z]{2}\d{4})\b", 1), (r"\bprotocol\s*#?\s*(\w+)\b", 1)],
    "domain": [(r"\b(?:domain|sdtm|adam)\s+([A-Za-z]+)\b", 1), (r"\b(?:demographics|adverse\s+events|efficacy|safety)\b", 0)],
}
#: (type, verb, confidence): both sides are what stands before and after in a run of words, so they need no pattern of their own.
ADVANCED_RELATIONS = [
    ("received", r"received|took|was\s+given", 0.8), ("experienced", r"had|experienced|reported", 0.8), ("treated_with", r"treated\s+with|managed\s+with", 0.7),
    ("associated_with", r"associated\s+with|linked\s+to", 0.6), ("participated_in", r"participated\s+in|enrolled\s+in", 0.7), ("measured_in", r"measured\s+in|assessed\s+in", 0.6),
]
COMMON_TERMS = "HEMOGLOBIN CREATININE ALT AST WBC RBC HEADACHE NAUSEA VOMITING DIZZINESS".split()
DATE_FORMATS = ["yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "M/d/yyyy", "d/M/yyyy"]
RRF_K = 60
DENSE_WEIGHT = 0.7
SIMILARITY_THRESHOLD = 0.7
BM25_K1, BM25_B = 1.2, 0.75
