"""Column names and fixed values of the study table."""

# Names of the study columns.
PLAN = "Insurance_Plan"
POST_LEVEL = "SOA_Post_Lvl_Ind"
EXPECTED = "ExpDth_VBT2015wMI_Cnt"
ACTUAL = "Death_Count"
OBSERVATION_YEAR = "Observation_Year"
ISSUE_YEAR = "Issue_Year"
ISSUE_AGE = "Issue_Age"
SEX = "Sex"
SMOKER = "Smoker_Status"
ATTAINED_AGE = "Attained_Age"
FACE_BAND = "Face_Amount_Band"
DATASET = "DATASET"
ISSUE_YEAR_GROUP = "Issue_Year_Group"
PREDICTION = "prediction"

# Study selection.
TERM_PLAN = "TERM"
POST_LEVEL_EXCLUDED = "PLT"
LAST_TRAIN_YEAR = 2017
TRAIN = "TRAIN"
TEST = "TEST"

# Cell keys of the regression and of the boosted model.
REGRESSION_KEYS = [OBSERVATION_YEAR, ISSUE_YEAR, ISSUE_AGE, SEX, SMOKER, ATTAINED_AGE, FACE_BAND]
BOOST_KEYS = [SEX, SMOKER, ATTAINED_AGE, FACE_BAND]

# Category levels, in order.
SEX_LEVELS = ["M", "F"]
SMOKER_LEVELS = ["NS", "S", "U"]
FACE_BAND_LEVELS = [
    "01: 0 - 9,999",
    "02: 10,000 - 24,999",
    "03: 25,000 - 49,999",
    "04: 50,000 - 99,999",
    "05: 100,000 - 249,999",
    "06: 250,000 - 499,999",
    "07: 500,000 - 999,999",
    "08: 1,000,000 - 2,499,999",
    "09: 2,500,000 - 4,999,999",
    "10: 5,000,000 - 9,999,999",
    "11: 10,000,000+",
]
BASELINES = {SEX: "M", SMOKER: "NS", FACE_BAND: "05: 100,000 - 249,999"}
