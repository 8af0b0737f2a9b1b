"""Column names, code lists and labels shared by all operators."""

from __future__ import annotations

# --- column names -----------------------------------------------------------
PERSON = "person_id"
STAY_ID = "visit_occurrence_id"
SESSION_ID = "session_id"
START = "start"
SOURCE_CODE = "event_source_concept_id"
SOURCE_TYPE = "event_source_type_concept_id"
TARGET_CODE = "target_concept_id"
BIRTH = "birth_datetime"
DEATH = "death_datetime"
VISIT_START = "visit_start_datetime"
VISIT_END = "visit_end_datetime"
VISIT_TYPE = "visit_source_value"
INCLUSION_CONCEPT = "inclusion_event_source_concept_id"
INCLUSION_START = "inclusion_event_start"
FOLLOWUP_START = "followup_start"
OUTCOME = "y"
OUTCOME_STAY_ID = "outcome_visit_occurence_stay_id"
OUTCOME_DATETIME = "outcome_datetime"
LOS = "length_of_stay"
LOS_CATEGORY = "length_of_stay_category"
INCLUSION_MONTH = "inclusion_month"
INCLUSION_DAY_OF_WEEK = "inclusion_day_of_week"
INCLUSION_TIME_OF_DAY = "inclusion_time_of_day"
CONDITION_START = "condition_start_datetime"
CONDITION_CODE = "condition_source_value"
CONDITION_COARSE = "condition_source_value_coarse"
CODE_CLASS = "ICD10 category"

EVENT_COLUMNS = [PERSON, STAY_ID, START, SOURCE_CODE, FOLLOWUP_START, SOURCE_TYPE]

# --- task names --------------------------------------------------------------
TASK_MORTALITY = "mortality"
TASK_REHOSPITALIZATION = "rehospitalization"
TASK_LOS = "length_of_stay"
TASK_LOS_CATEGORICAL = "length_of_stay_categorical"
TASK_PROGNOSIS = "prognosis"
TASK_MACE = "MACE"

# --- fixed values: visit types and table names --------------------------------
COMPLETE_HOSPITALIZATION = "hospitalisés"
INCOMPLETE_HOSPITALIZATION = "hospitalisation incomplète"
HOSPITALIZATIONS = [COMPLETE_HOSPITALIZATION, INCOMPLETE_HOSPITALIZATION]

OMOP_TABLES = [
    "care_site",
    "concept",
    "concept_relationship",
    "condition_occurrence",
    "cost",
    "drug_exposure_administration",
    "drug_exposure_prescription",
    "fact_relationship",
    "measurement",
    "note_deid",
    "person",
    "procedure_occurrence",
    "visit_detail",
    "visit_detail_old",
    "visit_occurrence",
    "visit_occurrence_old",
    "vocabulary",
]

I2B2_TABLES = [
    "visit_occurrence",
    "person",
    "concept",
    "care_site",
    "visit_detail",
    "condition_occurrence",
    "procedure_occurrence",
    "drug_exposure",
]

# --- fixed values: visit type to standard concept -------------------------------
VISIT_CONCEPTS = {
    "consultation externe": 9202,
    "hospitalisation incomplète": 9201,
    "urgence": 9203,
    "hospitalisés": 9201,
}

# --- fixed values: person columns not kept as static features --------------------
UNUSED_PERSON_COLUMNS = [
    "person_source_value",
    "row_status_source_value",
    "row_status_concept_id",
    "race_source_value",
    "ethnicity_concept_id",
    "provider_id",
    "race_source_concept_id",
    "care_site_id",
    "ethnicity_source_concept_id",
    "ethnicity_source_value",
    "row_status_source_concept_id",
    "cdm_source",
    "race_concept_id",
    "gender_concept_id",
]

# --- fixed values: ICD10 codes of major adverse cardiac events --------------------
MACE_CODES = {
    "Acute Myocardial Infarction": ["I210", "I211", "I219", "I220", "I221", "I229"],
    "Unstable Angina": ["I200", "I208", "I209"],
    "Acute Heart Failure": [
        "I501", "I5020", "I5021", "I5022", "I5023", "I5030", "I5031", "I5032", "I5033",
    ],
    "Acute Cerebrovascular Events (Stroke)": [
        "I60", "I61", "I62", "I630", "I631", "I632", "I633", "I634", "I64",
    ],
    "Other codes from top pathologies": ["I24", "I23"],
}

# --- fixed values: ICD10 chapter labels -----------------------------------------
ICD10_CHAPTERS = {
    "1": "Certain infectious and parasitic diseases",
    "2": "Neoplasms",
    "3": "Diseases of the blood and blood-forming organs and certain disorders involving the immune mechanism",
    "4": "Endocrine, nutritional and metabolic diseases",
    "5": "Mental, Behavioral and Neurodevelopmental disorders",
    "6": "Diseases of the nervous system",
    "7": "Diseases of the eye and adnexa",
    "8": "Diseases of the ear and mastoid process",
    "9": "Diseases of the circulatory system",
    "10": "Diseases of the respiratory system",
    "11": "Diseases of the digestive system",
    "12": "Diseases of the skin and subcutaneous tissue",
    "13": "Diseases of the musculoskeletal system and connective tissue",
    "14": "Diseases of the genitourinary system",
    "15": "Pregnancy, childbirth and the puerperium",
    "16": "Certain conditions originating in the perinatal period",
    "17": "Congenital malformations, deformations and chromosomal abnormalities",
    "18": "Symptoms, signs and abnormal clinical and laboratory findings, not elsewhere classified",
    "19": "Injury, poisoning and certain other consequences of external causes",
    "20": "External causes of morbidity",
    "21": "Factors influencing health status and contact with health services",
    "22": "Codes for special purposes",
}

# --- fixed values: report labels --------------------------------------------------
MODEL_LABELS = {
    "ridge": "Logistic regression",
    "random_forests": "Random Forest",
    "hist_gradient_boosting": "Boosting",
}
DEMOGRAPHIC_LABELS = {
    0: "No demographics",
    3: "Age, sex and admission reason",
    6: "Age, sex, admission reason, destination, discharge type and value",
}
DECAY_LABELS = {
    "[0]": "No decay",
    "[0, 1]": "No decay and 1 day decay",
    "[0, 7]": "no decay and 7 days decay",
    "[0, 30]": "no decay and 30 days decay",
    "[0, 90]": "no decay and 90 days decay",
}
PREVALENCE_BINS = [0, 1, 4, 6, 11, 15, 20, 30, 50, 100]
SCORE_NAMES = [
    "roc_auc_score", "average_precision_score", "accuracy_score", "brier_score_loss",
]

# --- placeholder of this library: group of persons without a hospital
UNKNOWN_HOSPITAL = "unknown"
