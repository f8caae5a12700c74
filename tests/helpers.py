"""What the tests of the core share."""

SF = "/root/testdata/sf0.001"
# Line items are thin at this scale: one reading makes a day.
BUILD_OPTIONS = {"gold_weather_daily": {"min_hours": 1}}


def executed_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return [tuple(r) for r in df.collect()]
