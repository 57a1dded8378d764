"""Labels, column groups and explicit schemas of the tables the engine reads and returns."""

from pyspark.sql import types as T

# The two decision labels.
LONG = "LeaveHomeForMoreThanAWeek"
SHORT = "LeaveHomeForLessThanAWeek"

# Names of the metadata features, in output order.
CATEGORICAL = [
    "State", "MSA", "Tenure", "Income", "EmploymentStatus", "BuildingDamage", "DisasterType",
    "WaterAccess", "PowerAccess", "FoodAccess", "UnsanitaryConditions",
]
COUNTS = ["Occupants", "Kids5years", "Kids5_11years", "Kids12_17years"]
SCORES = ["damage_score", "water_score", "power_score", "food_score", "unsanitary_score",
          "total_severity_score"]
NUMERIC = COUNTS + SCORES

RESPONSES = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("y", T.IntegerType()),
])

ITEM_PARAMS = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("difficulty", T.DoubleType()),
])

SUBJECT_ABILITY = T.StructType([
    T.StructField("irt_model", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("ability", T.DoubleType()),
    T.StructField("correct", T.LongType()),
    T.StructField("observed_total", T.LongType()),
    T.StructField("missing_total", T.LongType()),
    T.StructField("coverage", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("ability_rank", T.IntegerType()),
    T.StructField("accuracy_rank", T.IntegerType()),
])


def subject_factors(k):
    """Schema of a fitted K-factor subject table."""
    return T.StructType(
        [T.StructField("k_factors", T.IntegerType()), T.StructField("model", T.StringType()),
         T.StructField("bias", T.DoubleType())]
        + [T.StructField(f"factor_{i}", T.DoubleType()) for i in range(1, k + 1)]
        + [T.StructField("correct", T.LongType()), T.StructField("observed_total", T.LongType()),
           T.StructField("missing_total", T.LongType()), T.StructField("coverage", T.DoubleType()),
           T.StructField("accuracy", T.DoubleType())])


SOCIO_ECONOMIC = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("State", "MSA", "Tenure", "Income")]
    + [T.StructField(n, T.DoubleType())
       for n in ("Occupants", "Kids5years", "Kids5-11years", "Kids12-17years")]
    + [T.StructField("EmploymentStatus", T.StringType())])


def household(disaster_type):
    """Household record; `DisasterType` is an array before the completeness filter, a string after."""
    return T.StructType([
        T.StructField("SocioEconomicParameters", SOCIO_ECONOMIC),
        T.StructField("BuildingDamage", T.StringType()),
        T.StructField("DisasterType", disaster_type),
        T.StructField("DisplacementDuration", T.StringType()),
        T.StructField("WaterAccess", T.StringType()),
        T.StructField("PowerAccess", T.StringType()),
        T.StructField("FoodAccess", T.StringType()),
        T.StructField("UnsanitaryConditions", T.StringType()),
        T.StructField("InformGPTMethod", T.StringType()),
    ])


RUN_METADATA = T.StructType([
    T.StructField("LLMModel", T.StringType()),
    T.StructField("PromptingStrategy", T.StringType()),
    T.StructField("Temperature", T.DoubleType()),
    T.StructField("Seed", T.LongType()),
    T.StructField("SampleSize", T.StringType()),
    T.StructField("Start", T.LongType()),
    T.StructField("Limit", T.LongType()),
    T.StructField("NumPreparedHouseholds", T.LongType()),
    T.StructField("NumSelectedHouseholds", T.LongType()),
    T.StructField("HouseholdRuntimeSeconds", T.ArrayType(T.DoubleType())),
    T.StructField("TotalRuntimeSeconds", T.DoubleType()),
    T.StructField("AverageRuntimeSecondsPerCompletedHousehold", T.DoubleType()),
    T.StructField("Accuracy", T.DoubleType()),
])

RUN_RESULT = T.StructType([
    T.StructField("AgentDecisions", T.ArrayType(T.StringType())),
    T.StructField("DisplacementDurationsMappedToDecisions", T.ArrayType(T.StringType())),
    T.StructField("DisplacementDurations", T.ArrayType(T.StringType())),
    T.StructField("HouseholdInfo", T.ArrayType(household(T.StringType()))),
    T.StructField("Errors", T.ArrayType(T.StructType([
        T.StructField("Index", T.LongType()),
        T.StructField("ErrorType", T.StringType()),
        T.StructField("ErrorMessage", T.StringType()),
        T.StructField("HouseholdInfo", household(T.StringType())),
    ]))),
    T.StructField("RunMetadata", RUN_METADATA),
])
