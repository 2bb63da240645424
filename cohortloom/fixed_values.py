"""Names, word lists and parameters that results depend on.

Everything here is plain data that has to be exactly as written for results to
match; nothing in this module is computed.
"""

# --- fixed values: names ----------------------------------------------------
ID_COLUMN = "nct_id"
LABEL_COLUMN = "label_feasible"
PCA_PREFIX = "pca_emb_"
EMBEDDING_PREFIX = "embedding_"
FLAG_PREFIX = "is_"
INPUT_MODES = ("tabular", "tabular_plus_embeddings")

# --- fixed values: record filters -------------------------------------------
ACCEPTED_PHASES = ["PHASE2", "PHASE3", "PHASE4", "PHASE2|PHASE3"]
ACCEPTED_STUDY_TYPE = "INTERVENTIONAL"
ACCEPTED_SPONSOR_CLASS = "INDUSTRY"

# --- fixed values: status groups --------------------------------------------
POSITIVE_STATUSES = ["COMPLETED"]
NEGATIVE_STATUSES = ["TERMINATED", "WITHDRAWN", "SUSPENDED"]
COHORT_STATUSES = ["RECRUITING", "ACTIVE_NOT_RECRUITING", "ENROLLING_BY_INVITATION"]
ONGOING_STATUSES = [
    "RECRUITING",
    "ACTIVE_NOT_RECRUITING",
    "ENROLLING_BY_INVITATION",
    "NOT_YET_RECRUITING",
    "UNKNOWN",
]

# --- fixed values: geography ------------------------------------------------
US_COUNTRY = "United States"
CHINA_COUNTRY = "China"
EU_COUNTRIES = ["Germany", "France", "Italy", "Spain", "United Kingdom"]

# --- fixed values: text fields joined for embedding, in this order ----------
DESCRIPTION_FIELDS = [
    "brief_title",
    "official_title",
    "brief_summary",
    "detailed_description",
    "eligibility_criteria_text",
]

# --- fixed values: keys tried, in this order, for an ontology leaf ----------
ONTOLOGY_KEYS = ["meshTerm", "term", "name", "title"]

# --- fixed values: disease keywords, matched in condition_text --------------
DISEASE_KEYWORDS = {
    "is_nsclc": [
        "non-small cell lung cancer",
        "nsclc",
        "non small cell lung cancer",
        "non-small-cell lung cancer",
    ],
    "is_sclc": ["small cell lung cancer", "sclc"],
    "is_lung_cancer": ["lung cancer", "lung carcinoma", "lung neoplasm", "lung tumor"],
    "is_breast_cancer": ["breast cancer", "breast carcinoma", "breast neoplasm"],
    "is_prostate_cancer": ["prostate cancer", "prostate carcinoma", "prostate neoplasm"],
    "is_colorectal_cancer": ["colorectal cancer", "colon cancer", "rectal cancer"],
    "is_gastric_cancer": ["gastric cancer", "stomach cancer", "gastric carcinoma"],
    "is_pancreatic_cancer": ["pancreatic cancer", "pancreas cancer", "pancreatic carcinoma"],
    "is_hepatocellular": ["hepatocellular", "liver cancer", "hcc"],
    "is_renal": ["renal cell", "kidney cancer", "rcc"],
    "is_bladder": ["bladder cancer", "bladder carcinoma"],
    "is_ovarian": ["ovarian cancer", "ovary cancer"],
    "is_cervical": ["cervical cancer", "cervix cancer"],
    "is_endometrial": ["endometrial cancer", "endometrium cancer"],
    "is_esophageal": ["esophageal cancer", "oesophageal cancer"],
    "is_head_neck": ["head and neck cancer", "head neck cancer"],
    "is_brain": ["brain cancer", "brain tumor", "glioma"],
    "is_thyroid": ["thyroid cancer", "thyroid carcinoma"],
    "is_sarcoma": ["sarcoma"],
    "is_lymphoma": ["lymphoma"],
    "is_myeloma": ["myeloma", "multiple myeloma"],
    "is_aml": ["acute myeloid leukemia", "aml"],
    "is_all": ["acute lymphoblastic leukemia", "all"],
    "is_cll": ["chronic lymphocytic leukemia", "cll"],
    "is_cml": ["chronic myeloid leukemia", "cml"],
}

GENERAL_CANCER_TERMS = [
    "cancer",
    "carcinoma",
    "neoplasm",
    "tumor",
    "tumour",
    "malignancy",
    "malignant",
]

# Flag columns left out of the catch-all sum.
CATCH_ALL_IGNORED = ["is_multicountry", "is_randomized", "is_blinded"]

# --- fixed values: intervention keywords ------------------------------------
INTERVENTION_KEYWORDS = {
    "is_immunotherapy": [
        "immunotherapy",
        "immune checkpoint",
        "pd-1",
        "pd1",
        "pd-l1",
        "pdl1",
        "ctla-4",
        "nivolumab",
        "pembrolizumab",
        "atezolizumab",
    ],
    "is_tki": [
        "tyrosine kinase inhibitor",
        "tki",
        "erlotinib",
        "gefitinib",
        "osimertinib",
        "afatinib",
        "icotinib",
    ],
    "is_adc": [
        "antibody drug conjugate",
        "adc",
        "trastuzumab emtansine",
        "trastuzumab deruxtecan",
    ],
    "is_chemo": [
        "chemotherapy",
        "chemo",
        "cisplatin",
        "carboplatin",
        "paclitaxel",
        "docetaxel",
        "pemetrexed",
    ],
    "is_hormone": ["hormone therapy", "hormonal therapy", "tamoxifen", "aromatase inhibitor"],
    "is_cell_therapy": ["car-t", "cart", "cell therapy", "t-cell therapy"],
    "is_targeted": ["targeted therapy", "targeted treatment", "molecularly targeted"],
    "is_radiotherapy": ["radiotherapy", "radiation therapy", "radiation treatment"],
    "is_surgery": ["surgery", "surgical", "resection"],
}

# --- fixed values: cohort terms used when the flag column is absent ---------
COHORT_KEYWORDS = [
    "non small cell lung cancer",
    "nsclc",
    "non-small cell lung cancer",
    "non-small-cell lung cancer",
    "non-small-cell lung carcinoma",
]

# --- fixed values: section markers and bullets ------------------------------
INCLUSION_MARKER = "inclusion"
EXCLUSION_MARKER = "exclusion"
BULLET_CHARACTERS = "•-*"

# --- fixed values: column groups --------------------------------------------
TEXT_COLUMNS = [
    "brief_title",
    "official_title",
    "brief_summary",
    "detailed_description",
    "eligibility_criteria_text",
    "condition_text",
    "intervention_text",
    "description_text",
]

NESTED_COLUMNS = [
    "condition_list",
    "condition_mesh_terms",
    "intervention_mesh_terms",
    "interventions",
    "intervention_names",
    "intervention_types",
    "arm_groups",
    "phases_list",
    "primary_outcomes",
    "primary_outcome_measures",
    "secondary_outcomes",
    "secondary_outcome_measures",
    "other_outcome_measures",
    "collaborators",
    "references",
    "overall_officials",
    "central_contacts",
    "secondary_ids",
    "keywords",
    "facility_countries",
    "facility_cities",
    "facility_states",
    "std_ages",
    "see_also_links",
    "avail_ipds",
    "ipd_sharing_info_types",
]

LEAKAGE_COLUMNS = [
    "is_historical",
    "feasibility_label",
    "overall_status",
    "last_known_status",
    "why_stopped",
    "has_results",
    "completion_date",
    "primary_completion_date",
    "last_update_posted_date",
    "last_update_submit_date",
    "first_posted_date",
    "results_first_posted_date",
    "results_first_submit_date",
    "results_first_submit_qc_date",
    "study_first_submit_date",
    "study_first_submit_qc_date",
    "status_verified_date",
    "enrollment_actual",
    "enrollment_actual_type",
    "enrollment_actual_num",
]

LEAKAGE_PATTERNS = [
    "posted_date",
    "completion_date",
    "is_historical",
    "submit_date",
    "status_verified",
    "why_stopped",
    "has_results",
]

LEAKAGE_AUDIT_PATTERNS = [
    "completion_date",
    "primary_completion_date",
    "trial_duration_days",
    "why_stopped",
    "enrollment_actual_num",
    "overall_status",
    "last_known_status",
    "has_results",
    "is_historical",
]

EXCLUDED_COLUMNS = [
    "acronym",
    "biospec_description",
    "biospec_retention",
    "gender_based",
    "gender_description",
    "intervention_model_description",
    "ipd_sharing_access_criteria",
    "ipd_sharing_description",
    "ipd_sharing_time_frame",
    "ipd_sharing_url",
    "is_ppsd",
    "is_unapproved_device",
    "is_us_export",
    "lead_sponsor_type",
    "observational_model",
    "patient_registry",
    "responsible_party_investigator_affiliation",
    "responsible_party_investigator_full_name",
    "responsible_party_investigator_title",
    "responsible_party_name",
    "responsible_party_organization",
    "sampling_method",
    "sex",
    "study_population",
    "study_type",
    "target_duration",
    "time_perspective",
    "who_masked",
]

# --- fixed values: scored output --------------------------------------------
SCORED_COLUMNS = [
    "overall_status",
    "phase_simple",
    "sponsor_name",
    "intervention_model",
    "allocation",
    "start_year",
    "enrollment_planned_num",
    "num_countries",
    "number_of_facilities",
    "has_us_sites",
    "has_eu_sites",
    "has_china_sites",
]
SCORED_ALTERNATIVES = {"sponsor_name": "lead_sponsor_name"}
SCORED_EXTRAS = [
    "masking",
    "primary_purpose",
    "enrollment_actual_num",
    "num_arms",
    "has_placebo",
    "is_blinded",
    "eligibility_complexity_score",
    "start_date",
    "primary_completion_date",
    "completion_date",
]
CRITICAL_COLUMNS = [
    "nct_id",
    "overall_status",
    "phase_simple",
    "p_completion",
    "rank_nsclc",
    "risk_bucket",
]
BUCKETS = ["LOW", "MEDIUM", "HIGH"]
FACILITY_COLUMNS = ["number_of_facilities", "num_facilities", "facility_count"]

# --- fixed values: feature groups counted in the dataset summary ------------
DISEASE_GROUP = [
    "nsclc",
    "sclc",
    "breast",
    "prostate",
    "colorectal",
    "gastric",
    "pancreatic",
    "other_cancer",
    "other",
]
INTERVENTION_GROUP = [
    "immuno",
    "tki",
    "adc",
    "chemo",
    "hormone",
    "cell",
    "targeted",
    "radio",
    "surgery",
]
COMPLEXITY_GROUP = ["eligibility", "inclusion", "exclusion"]

# --- fixed values: experiment parameters ------------------------------------
SEED = 42
TEST_FRACTION = 0.2
VALIDATION_FRACTION = 0.15
VARIANCE_KEPT = 0.95
MIN_SELECTED_FEATURES = 10
RUNS = 10
FOLDS = 5
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]
STRATEGY_RATIOS = {
    "class_weight": None,
    "downsample_balanced": 1.0,
    "downsample_1_5": 1.5,
    "partial_downsample": 2.0,
}
OVERSAMPLE_RATIOS = [0.6, 0.8, 1.0]
EMBEDDING_BATCH = 32
HISTOGRAM_BINS = 50
LOW_RISK_PERCENTILE = 0.70
HIGH_RISK_PERCENTILE = 0.30

SELECTION_PARAMS = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8}
FOREST_GRID = {
    "numTrees": [100, 200, 300],
    "maxDepth": [10, 20, 30],
    "featureSubsetStrategy": ["sqrt", "log2"],
}
BOOSTED_GRID = {
    "maxIter": [100, 200, 300],
    "maxDepth": [3, 5, 7],
    "stepSize": [0.01, 0.05, 0.1],
    "subsamplingRate": [0.8, 0.9],
    "featureSubsetStrategy": ["0.8", "0.9"],
}
GRIDS = {"forest": FOREST_GRID, "boosted": BOOSTED_GRID}

# --- fixed values: the two-input network
NETWORK_PARAMS = {
    "towers": ((32, 64), (64, 64)),
    "combined": 128,
    "last": 64,
    "dropout": 0.3,
    "stepSize": 0.001,
    "decay": 1e-4,
    "epochs": 100,
    "patience": 5,
}
