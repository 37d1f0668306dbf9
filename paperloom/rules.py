"""Word lists and settings as parameters, with the values the project ships."""

from __future__ import annotations

from dataclasses import dataclass, field

# The grid's countries, categories in slot order, and the papers wanted in each cell.
COUNTRIES = ["Thailand", "Vietnam", "Japan"]
CATEGORIES = [
    "Stereotypes / Ageism",
    "Work Values / Work Ethic",
    "Knowledge Transfer / Mentoring",
    "Communication / Psychological Safety",
    "Change Adaptation / Technology Adoption",
    "Status Quo Bias / Resistance to Change",
]
PAPERS_PER_SLOT = 2

# Words that place a text in a country.
COUNTRY_WORDS = {
    "Thailand": ["Thailand", "Thai", "Bangkok", "Siam"],
    "Vietnam": ["Vietnam", "Viet Nam", "Vietnamese", "Hanoi", "Ho Chi Minh"],
    "Japan": ["Japan", "Japanese", "Tokyo", "Osaka", "Nippon"],
}

# Words of each category.
CATEGORY_WORDS = {
    "Stereotypes / Ageism": ["ageism", "age discrimination", "age stereotype", "generational stereotype", "older worker", "older employee", "age bias", "ageist"],
    "Work Values / Work Ethic": ["work values", "work ethic", "work-life balance", "generational values", "generation Z", "millennial", "work attitude", "work orientation"],
    "Knowledge Transfer / Mentoring": ["knowledge transfer", "knowledge sharing", "intergenerational knowledge", "mentoring", "reverse mentoring", "tacit knowledge", "knowledge retention", "mentorship"],
    "Communication / Psychological Safety": ["psychological safety", "employee voice", "speaking up", "power distance", "communication", "hierarchy", "voice behavior", "silence"],
    "Change Adaptation / Technology Adoption": ["technology adoption", "digital transformation", "digital skills", "technology acceptance", "change adaptation", "digitalization", "digital divide", "ICT adoption"],
    "Status Quo Bias / Resistance to Change": ["resistance to change", "status quo bias", "organizational change", "change resistance", "readiness for change", "change management", "inertia", "openness to change"],
}

# Words of organisational, medical and physical context.
ORGANISATION_WORDS = [
    "employee", "employees", "organization", "organisation", "organizational", "organisational", "company", "firm", "team", "teams", "management", "manager", "leadership", "HRM", "human resource", "workforce",
    "workplace culture", "organizational culture", "psychological safety", "employee voice", "knowledge sharing", "knowledge transfer", "mentoring", "resistance to change", "technology adoption", "work values",
    "work ethic", "generation", "generational", "intergenerational", "ageism", "age stereotype", "power distance", "corporate", "staff", "colleague",
]
MEDICAL_WORDS = [
    "disease", "infection", "infectious", "patient", "patients", "hospital", "clinical", "case-control", "case control", "PCR", "ELISA", "epidemiology", "epidemiological", "odds ratio", "confidence interval",
    "diagnosis", "diagnostic", "mortality", "morbidity", "public health", "scrub typhus", "seroprevalence", "pathogen", "vaccine", "outbreak",
]
PHYSICAL_WORDS = ["forest", "hilly field", "water bodies", "bushes", "agricultural field", "paddy field", "farmland", "infection risk", "occupational exposure", "vector", "rodent", "mosquito", "soil", "vegetation"]

# Heading beginnings of parts that are kept, shortened and dropped.
KEEP_HEADINGS = [
    "abstract", "introduction", "literature review", "related work", "theoretical background", "conceptual background", "theoretical framework", "background", "findings", "results", "discussion", "conclusion", "conclusions",
    "concluding remarks", "summary", "policy recommendation", "policy recommendations", "policy implications", "implications", "limitations", "limitations and future research", "future research", "case description", "case study",
]
METHODS_HEADINGS = ["methods", "method", "methodology", "materials and methods", "research method", "research methodology", "research design", "data and methods", "data collection", "research setting", "sample"]
DROP_HEADINGS = [
    "references", "reference", "bibliography", "appendix", "appendices", "acknowledgement", "acknowledgements", "acknowledgments", "funding", "author contributions", "authors contributions", "conflict of interest",
    "conflicts of interest", "declaration of competing interest", "competing interests", "ethics", "ethics statement", "ethical approval", "data availability", "data availability statement", "informed consent", "copyright",
    "table of contents", "contents", "supplementary material", "supplementary materials", "notes", "endnotes", "about the authors",
]

# Words that keep a line.
GIOIA_WORDS = ["first-order", "first order", "second-order", "second order", "aggregate dimension", "aggregate dimensions", "gioia"]
EXCEPTION_WORDS = [
    *GIOIA_WORDS, "resistance to change", "psychological safety", "knowledge transfer", "knowledge sharing", "technology adoption", "speaking up", "employee voice", "power distance", "reverse mentoring", "mentoring",
    "ageism", "stereotype", "work values", "work ethic", "barrier", "reluctan", "afraid", "fear of", "hesitat", "silence", "trust", "hierarchy", "authority", "respect", "face", "seniority",
]
METHODS_WORDS = [
    "interview", "qualitative", "participant", "respondent", "informant", "case study", "semi-structured", "semistructured", "focus group", "grounded theory", "gioia", "thematic", "narrative", "ethnograph",
    "thailand", "thai", "vietnam", "vietnamese", "japan", "japanese", "organization", "organisation", "company", "firm", "employees", "employee", "workplace", "sector", "industry",
]

# The search queries of each country and category.
QUERIES = {
    "Thailand": {
        "Stereotypes / Ageism": ["ageism workplace Thailand", "age discrimination older workers Thailand", "generational stereotype workplace Thailand"],
        "Work Values / Work Ethic": ["work values generation Thailand", "work ethic Generation Z Thailand", "work-life balance millennials Thailand"],
        "Knowledge Transfer / Mentoring": ["intergenerational knowledge transfer Thailand", "knowledge sharing young employees Thailand", "mentoring workplace Thailand"],
        "Communication / Psychological Safety": ["psychological safety workplace Thailand", "speaking up hierarchy Thailand", "employee voice power distance Thailand"],
        "Change Adaptation / Technology Adoption": ["digital transformation employees Thailand", "technology adoption older workers Thailand", "digital skills gap workplace Thailand"],
        "Status Quo Bias / Resistance to Change": ["resistance to change workplace Thailand", "organizational change resistance employees Thailand", "status quo bias organization Thailand"],
    },
    "Vietnam": {
        "Stereotypes / Ageism": ["ageism workplace Vietnam", "age discrimination older workers Vietnam", "generational stereotype workplace Vietnam"],
        "Work Values / Work Ethic": ["work values generation Vietnam", "work ethic Generation Z Vietnam", "work-life balance millennials Vietnam"],
        "Knowledge Transfer / Mentoring": ["intergenerational knowledge transfer Vietnam", "knowledge sharing young employees Vietnam", "reverse mentoring workplace Vietnam"],
        "Communication / Psychological Safety": ["employee voice power distance Vietnam", "psychological safety workplace Vietnam", "speaking up hierarchy Vietnam"],
        "Change Adaptation / Technology Adoption": ["digital transformation employees Vietnam", "digital skills gap workplace Vietnam", "technology adoption older workers Vietnam"],
        "Status Quo Bias / Resistance to Change": ["resistance to change workplace Vietnam", "organizational change resistance employees Vietnam", "status quo bias organization Vietnam"],
    },
    "Japan": {
        "Stereotypes / Ageism": ["ageism workplace Japan", "age discrimination older workers Japan", "generational stereotype workplace Japan"],
        "Work Values / Work Ethic": ["work values generation Japan", "work ethic Generation Z Japan", "work-life balance millennials Japan"],
        "Knowledge Transfer / Mentoring": ["intergenerational knowledge transfer Japan", "reverse mentoring workplace Japan", "knowledge sharing young employees Japan"],
        "Communication / Psychological Safety": ["psychological safety workplace Japan", "employee voice power distance Japan", "speaking up hierarchy Japan"],
        "Change Adaptation / Technology Adoption": ["technology adoption older workers Japan", "digital transformation employees Japan", "digital skills gap workplace Japan"],
        "Status Quo Bias / Resistance to Change": ["status quo bias organization Japan", "resistance to change workplace Japan", "organizational change resistance employees Japan"],
    },
}

# Columns of a candidate in order, and the ones that only the JSON form has.
CANDIDATE_COLUMNS = [
    "id", "country", "category", "slot", "title", "authors", "year", "journal_source", "doi", "url", "pdf_url", "oa_status", "oa_source", "license", "target_country_region", "research_context", "abstract", "related_category",
    "country_score", "workplace_organization_score", "category_score", "exclusion_medical_score", "reason_for_inclusion", "screening_status", "screening_reason", "legal_download_status", "legal_download_reason",
    "pdf_checked_at", "local_pdf_path", "notes", "duplicate_of", "created_at", "updated_at",
]
JSON_ONLY_COLUMNS = ["is_oa", "source_api", "openalex_id"]
# Other names of columns, tried in order.
COLUMN_ALIASES = {
    "country": ["country", "Country", "target_country_region"],
    "category": ["category", "Category"],
    "title": ["title", "Title"],
    "local_pdf_path": ["local_pdf_path", "pdf_path", "local_path", "localPdfPath"],
    "screening_status": ["screening_status", "status", "screeningStatus"],
}


@dataclass(frozen=True)
class Words:
    """The word lists of one screening run."""

    country: dict[str, list[str]] = field(default_factory=lambda: COUNTRY_WORDS)
    category: dict[str, list[str]] = field(default_factory=lambda: CATEGORY_WORDS)
    organisation: list[str] = field(default_factory=lambda: ORGANISATION_WORDS)
    medical: list[str] = field(default_factory=lambda: MEDICAL_WORDS)
    physical: list[str] = field(default_factory=lambda: PHYSICAL_WORDS)


def load_yaml(path: str) -> object:
    """A YAML file (UTF-8), plain values only."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def load_category_words(path: str) -> dict[str, list[str]]:
    """Words of each category, in the order of their ``index``, from a file of ``name: {index, keywords}``."""
    got = load_yaml(path) or {}
    return {k: list(v.get("keywords") or []) for k, v in sorted(got.items(), key=lambda e: e[1].get("index") or 0)}


def load_country_words(path: str) -> dict[str, list[str]]:
    """Words of each country, from a file of ``name: [words]``."""
    return {k: list(v or []) for k, v in (load_yaml(path) or {}).items()}


def load_context_words(path: str) -> dict[str, list[str]]:
    """The word lists of a rule file by their keys (``organizational_keywords``, ``medical_exclusion_keywords``, ...); its other settings are left out."""
    return {k: v for k, v in (load_yaml(path) or {}).items() if isinstance(v, list)}


def load_queries(path: str) -> dict[str, dict[str, list[str]]]:
    """Search queries by country and category, from a file of that shape; missing cells are empty."""
    return {c: {k: list(qs or []) for k, qs in (cells or {}).items()} for c, cells in (load_yaml(path) or {}).items()}


def load_words(country: str | None = None, category: str | None = None, context: str | None = None) -> Words:
    """The word lists of a screening run from its rule files; what no file gives keeps its shipped value."""
    got = {}
    if country:
        got["country"] = load_country_words(country)
    if category:
        got["category"] = load_category_words(category)
    if context:
        words = load_context_words(context)
        keys = {"organisation": "organizational_keywords", "medical": "medical_exclusion_keywords", "physical": "physical_environment_keywords"}
        got |= {k: words[v] for k, v in keys.items() if v in words}
    return Words(**got)
