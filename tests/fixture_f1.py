"""The two-pupil snapshot of FIXTURES.md (F1), the same for three years."""

from pyspark.sql import types as T

COLUMNS = [
    ("RA", T.StringType()), ("Nome", T.StringType()), ("Turma", T.StringType()),
    ("Instituição de ensino", T.StringType()), ("INDE 22", T.DoubleType()), ("Matem", T.DoubleType()),
    ("Portug", T.DoubleType()), ("Inglês", T.DoubleType()), ("Pedra 20", T.IntegerType()),
    ("Pedra 21", T.IntegerType()), ("Pedra 22", T.IntegerType()), ("IEG", T.DoubleType()), ("IPS", T.DoubleType()),
    ("Indicado", T.StringType()), ("Rec Psicologia", T.StringType()), ("Rec Av1", T.StringType()),
    ("Rec Av2", T.StringType()), ("Rec Av3", T.StringType()), ("Rec Av4", T.StringType()),
    ("Ativo/ Inativo", T.StringType()), ("IAA", T.DoubleType()), ("IDA", T.DoubleType()), ("IPV", T.DoubleType()),
    ("IAN", T.DoubleType()),
]
ROWS = [
    ("111", "Aluno A", "T1", "Escola X", 5.0, 5.0, 6.0, 6.0, 2, 2, 2, 0.30, 0.35, "Sim", "", "", "", "", "",
     "Inativo", 0.40, 0.30, 0.20, 0.10),
    ("222", "Aluno B", "T1", "Escola X", 7.5, 8.0, 7.0, 7.5, 4, 4, 4, 0.70, 0.70, "Não", "", "OK", "", "", "",
     "Ativo", 0.80, 0.70, 0.60, 0.50),
]


def snapshot(spark):
    return spark.createDataFrame(ROWS, T.StructType([T.StructField(n, t) for n, t in COLUMNS]))


def stacked(spark, years=(2022, 2023, 2024)):
    from cohort_spark.sources.io import stack_years
    return stack_years({y: snapshot(spark) for y in years})
