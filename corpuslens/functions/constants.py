"""Fixed values of the query semantics: word lists, patterns, weights. They decide results and must stay as they are."""

# Stopwords. Those of three letters or fewer are kept as tokens all the same.
STOPWORDS = """
the a an and or but in on at to for of with by from up about into through during is are was were be been being have has had
do does did will would could should may might shall can this that these those it its they them their we our you your he she
his her i my me us which who whom when where why how what all each both few more most other some such no not only same so
than then there too very just also even much well back still way per
""".split()
DROPPED = [w for w in STOPWORDS if len(w) > 3]

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "dna": "deoxyribonucleic acid dna",
    "rna": "ribonucleic acid rna",
    "mrna": "messenger ribonucleic acid mrna",
    "mirna": "micro ribonucleic acid mirna",
    "pcr": "polymerase chain reaction pcr",
    "elisa": "enzyme linked immunosorbent assay elisa",
    "ct": "computed tomography ct scan",
    "mri": "magnetic resonance imaging mri",
    "ecg": "electrocardiogram ecg ekg",
    "bp": "blood pressure bp",
    "hr": "heart rate hr",
    "bmi": "body mass index bmi",
    "auc": "area under curve auc",
    "ci": "confidence interval ci",
    "rr": "relative risk rr risk ratio",
    "or": "odds ratio or",
    "hr_stat": "hazard ratio",
    "p53": "tumor protein p53 tp53",
    "vegf": "vascular endothelial growth factor vegf",
    "tnf": "tumor necrosis factor tnf",
    "il": "interleukin",
}

#: A letter, digit or _, and white space, of any script.
W, S = r"[\p{L}\p{N}_]", r"(?U:\s)"

# Fixed values: (pattern, replacement) of the cleaning passes, in order.
CLEANING = [
    (rf"(?! (?!{S})){S}+", " "),  # single spaces stay as they are
    (rf"({W})-{S}+({W})", "$1$2"),
    (r"\[\d+\]", ""),
    (rf"(?<=[A-Za-z%])\.\d{{1,3}}(?:,\d{{1,3}})*(?={S}+[A-Za-z])", "."),
    (rf"(?<=[A-Za-z])(,\d{{1,3}})+(?={S}+[a-z])", ""),
    (r"(?<=[.)]) \d{1,3}(?: , \d{1,3})* (?=[A-Za-z])", " "),
    (r" \d{1,3}(?: , \d{1,3}){2,} (?=[A-Za-z])", " "),
    (r"(?<=[A-Za-z]), \d{1,3}(?: , \d{1,3})* (?=[a-z])", " "),
    (rf"(?! (?!{S})){S}+", " "),
]

# Abbreviations after which a sentence goes on.
SENTENCE_GUARDS = ["et al", "e.g", "i.e", "vs", "Dr", "Mr", "Ms", "Prof", "Fig", "Tab", "Eq", "approx", "avg", "max", "min", "std", "SD", "SE"]

# Beginnings of sentences that open a section, in order of precedence.
SECTIONS = [
    (r"abstract\b", "Abstract"),
    (r"(introduction|background)\b", "Introduction"),
    (r"(method|methodology|materials?\s+and\s+method)", "Methods"),
    (r"result", "Results"),
    (r"discussion", "Discussion"),
    (r"conclusion", "Conclusion"),
    (r"(reference|bibliography)", "References"),
    (r"(supplementary|appendix)", "Supplementary"),
]

# Intents by what a question contains, in order of precedence.
INTENTS = {
    "mechanism": ["how does", "mechanism", "pathway", "process", "work"],
    "comparison": ["compare", "difference", "versus", "vs", "better", "worse", "superior"],
    "causation": ["cause", "why", "reason", "lead to", "result in", "due to"],
    "treatment": ["treat", "therapy", "intervention", "drug", "dose", "efficacy"],
    "diagnosis": ["diagnose", "detect", "identify", "marker", "criterion", "symptom"],
    "prognosis": ["prognosis", "survival", "outcome", "predict", "mortality", "recurrence"],
    "epidemiology": ["prevalence", "incidence", "population", "risk factor", "epidemiology"],
    "definition": ["what is", "define", "definition", "describe"],
}
QUANTITATIVE = ["epidemiology", "prognosis", "treatment"]

# Capitalised words that are no entity when they stand alone.
NOT_ENTITIES = """
What Which Who Whom Whose How Why When Where Is Are Was Were Do Does Did Can Could Should Would Will Shall May Might Have Has
Had The A An This That These Those
""".split()

# Weights of sections by intent; 1.0 where none is given, "general" for other intents.
SECTION_WEIGHTS = {
    "mechanism": {"Results": 1.3, "Methods": 1.1, "Discussion": 1.0, "Abstract": 0.9},
    "comparison": {"Results": 1.4, "Discussion": 1.2, "Abstract": 1.0},
    "treatment": {"Results": 1.4, "Methods": 1.2, "Discussion": 1.0},
    "diagnosis": {"Results": 1.3, "Methods": 1.2, "Abstract": 1.0},
    "definition": {"Introduction": 1.3, "Abstract": 1.2, "Body": 1.0},
    "general": {"Abstract": 1.1, "Results": 1.1, "Discussion": 1.0},
}

# Words that tell no topic from another.
GENERIC_TERMS = """
biomarker biomarkers marker markers disease diseases patient patients study studies treatment treatments expression level levels
plasma blood serum cell cells protein proteins gene genes clinical risk therapy therapies analysis result results finding
findings association tumor tumour sample data method methods diagnosis prognosis detection prediction response factor factors
effect effects increase decrease significant significantly compared group groups control measure measurement outcome outcomes
cohort population baseline median mean ratio age sex test tissue model concentration type predict predicted predictive
predictor predictors detect detected detectable identify identified assess assessed assessment evaluate evaluated measured
determine determined associate associated correlate correlated correlation indicate indicated demonstrate demonstrated report
reported investigate investigated suggest suggested compare improve improved reduce reduced inhibit inhibited use used using
show shown found early late novel potential effective accurate sensitive specific elevated increased decreased high low new
current recent common
""".split()

# Evidence patterns over lower-cased text, contradictory ones first.
CONTRADICTORY = [
    r"\b(contradict|inconsistent|conflict|contrary|dispute|challenge|refute)\b",
    r"\b(however|nevertheless|in contrast|on the other hand)\b.*\b(no|not|fail)\b",
    r"\b(no significant|non-significant|failed to|did not|could not)\b",
]
DIRECT = [
    r"\b(demonstrate|show|reveal|confirm|establish|prove|indicate|suggest)\b",
    r"\b(significant|p\s*[<=>]\s*0\.\d+|odds ratio|hazard ratio)\b",
    r"\b(result|finding|observation|data|evidence)\b.*\b(support|consistent)\b",
]
# Patterns of statistics, names, quantities and old years.
STATISTICS = r"(?:p\s*[<=>]\s*0\.\d+|OR\s*=?\s*[\d.]+|HR\s*=?\s*[\d.]+|95%\s*CI|RR\s*=?\s*[\d.]+|\d+\.?\d*%)"
ENTITY = r"\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+)*\b"
KEY_ENTITY = r"\b[A-Z][A-Za-z0-9\-]{2,}(?:\s+[A-Z][A-Za-z0-9\-]{2,}){0,2}\b"
HAS_NUMBERS = r"\d+\.?\d*%|\bp\s*[<=>]|odds ratio|hazard ratio"
OLD_YEAR = r"\b(19|200[0-5])\d{2}\b"

# Follow-up questions by intent, "general" for other intents.
FOLLOW_UPS = {
    "mechanism": ["What are the downstream effects of {entity}?", "Which molecular targets are involved in this pathway?", "Are there known inhibitors or activators of this mechanism?"],
    "comparison": ["What are the contraindications for each option?", "How do these options compare in specific patient populations?", "What does meta-analytic evidence say about this comparison?"],
    "treatment": ["What is the recommended dosage range and administration route?", "What are the most common adverse effects reported?", "Is there evidence of treatment resistance or tolerance?"],
    "diagnosis": ["What is the sensitivity and specificity of this diagnostic approach?", "What are the differential diagnoses to consider?", "Are there validated clinical scoring systems for this condition?"],
    "general": ["Can you provide more detail on the methodology used in these studies?", "Are there clinical guidelines that address this topic?", "What patient populations were studied?"],
}

# BM25, prefix fallback, rank fusion, recall of telling terms.
K1, B = 1.5, 0.75
PREFIX_MIN, PREFIX_LEN, PREFIX_TERMS, PREFIX_WEIGHT = 7, 4, 3, 0.7
RRF_K = 60
EMPTY_DISCRIMINATIVE, MISSED_FACTOR, MATCH_BASE, MATCH_SHARE = 1.0, 0.15, 0.6, 0.4
