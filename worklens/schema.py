"""Declared schemas and the header names they are read from."""

from __future__ import annotations

from pyspark.sql import types as T

TASK_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("protocol_id", T.StringType()),
        T.StructField("analyst", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("queue", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("cause", T.StringType()),
        T.StructField("deviations", T.StringType()),
        T.StructField("duration_us", T.LongType()),
        T.StructField("completed_at", T.TimestampNTZType()),
        T.StructField("portfolio", T.StringType()),
        T.StructField("portfolio_status", T.StringType()),
        T.StructField("analysis_us", T.LongType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("justification", T.StringType()),
    ]
)

# The stored log's own columns beside those of TASK_LOG.
DURATION_BEFORE = T.StructField("duration_before_us", T.LongType())

UNAVAILABILITY_TEXT = T.StructType(
    [T.StructField("start_at", T.StringType()), T.StructField("end_at", T.StringType())]
)

ROSTER = T.StructType([T.StructField("analyst", T.StringType())])

# Spreadsheet header -> our column.
PORTUGUESE_HEADERS = {
    "NÚMERO DO PROTOCOLO": "protocol_id",
    "USUÁRIO QUE CONCLUIU A TAREFA": "analyst",
    "SITUAÇÃO DA TAREFA": "status",
    "TEMPO MÉDIO OPERACIONAL": "duration",
    "DATA DE CONCLUSÃO DA TAREFA": "completed_at",
    "DATA DE INÍCIO DA TAREFA": "started_at",
    "FINALIZAÇÃO": "outcome",
    "Justificativa": "justification",
    "FILA": "queue",
    "TAREFA": "task_type",
    "MÓDULO LB": "module",
    "TP CAUSA (TP COMPLEMENTO)": "cause",
    "DESVIOS CADASTRO": "deviations",
    "Carteira": "portfolio",
    "Status": "portfolio_status",
    "Tempo de Análise": "analysis",
    "Protocolo": "protocol_id",
}
