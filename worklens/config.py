"""Vocabulary (the words found in the data) and limits (the numbers applied to it)."""

from __future__ import annotations

from dataclasses import dataclass

MICROS = 1_000_000
MINUTE = 60 * MICROS
HOUR = 60 * MINUTE

# Handling-time limits of the cleaning rule, in microseconds.
REGISTERED_MIN = 19 * MINUTE  # anything shorter ...
REGISTERED_FLOOR = 20 * MINUTE  # ... becomes this
UPDATED_FLOOR = 3 * MINUTE
UPDATED_CEILING = 15 * MINUTE
DURATION_CEILING = 2 * HOUR

# Other limits.
DOUBT_LIMIT = 60 * MINUTE
IDLE_LIMIT_HOURS = 1
FAST_PORTFOLIO_LIMIT = 2 * MINUTE
PORTFOLIO_LIMIT = 5 * MINUTE
WORKDAY_START_HOUR = 8
WORKDAY_END_HOUR = 18

# Default windows of the charts, in days before the last day.
RECENT_PRODUCTIVITY_DAYS = 21
RECENT_DAYS = 30
RECENT_ANALYST_TMO_DAYS = 10
RECENT_ANALYST_TASKS_DAYS = 11


@dataclass(frozen=True)
class Vocabulary:
    """Every literal the operators compare data with."""

    # outcomes
    registered: str = "REGISTERED"
    updated: str = "UPDATED"
    distributed: str = "DISTRIBUTED"
    audited: str = "AUDITED"
    batch_closed: str = "BATCH_CLOSED"
    # statuses
    finished: str = "Finished"
    cancelled: str = "Cancelled"
    finished_variant: str = "Finalised"
    # queues
    doubt_queue: str = "DOUBT"
    unknown_queue: str = "Unknown"
    unlisted_queue: str = "Distribution"
    audit_queue: str = "AUDIT"
    distribution_queues: tuple[str, ...] = ("DIST", "DIST A")
    registration_excluded_queues: tuple[str, ...] = (
        "OFFICIAL LETTERS", "PRE REG", "PRE REG B", "AGENCIES", "REG FINES",
    )
    pre_registration_queues: tuple[str, ...] = ("PRE REG", "PRE REG B")
    official_letter_queue: str = "OFFICIAL LETTERS"
    agency_queue: str = "AGENCIES"
    email_queue: str = "REG EMAIL"
    email_other_queues: tuple[str, ...] = ("OFFICIAL LETTERS", "AGENCIES")
    queue_groups: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("CAPTURE", (" REG ROBOT", "INCIDENT", "REG ANS")),
        ("SHARED", ("REG SHARED", "UPD SHARED")),
        ("SUMMONS", ("REG SUMMONS", "UPD SUMMONS")),
        ("EMAIL", ("REG EMAIL", "OFFICIAL LETTERS EMAIL", "AGENCIES")),
        ("PRE", ("PRE REG",)),
    )
    other_group: str = "OTHER"
    # people
    robot_user: str = "Robot_Hub"
    external_marker: str = "_ter"
    best_excluded: str | None = None  # one user never shown as best of a queue
    # older export columns
    fast_portfolio: str = "FAST"
    portfolio_closed: str = "CLOSED"
    portfolio_reclassified: str = "RECLASSIFIED"
    portfolio_in_progress: str = "IN_PROGRESS"
    # audit findings
    no_deviation: str = "No deviation"
    # columns never stored, compared in upper case without outer blanks
    dropped_columns: tuple[str, ...] = ()

    @property
    def production(self) -> tuple[str, ...]:
        return (self.registered, self.updated, self.distributed)

    @property
    def handled(self) -> tuple[str, ...]:
        return (self.registered, self.updated)


DEFAULT = Vocabulary(dropped_columns=("ID NIP", "M.O."))


def portuguese_vocabulary(
    tenant: str, fast_portfolio: str, best_excluded: str | None = None
) -> Vocabulary:
    """Words of the original Portuguese exports.

    Some queue, column and user names carry the tenant's name, so the caller
    gives it; so are the portfolio with the short limit and any user left out.
    """
    # Words of the exported spreadsheets.
    return Vocabulary(
        registered="CADASTRADO",
        updated="ATUALIZADO",
        distributed="REALIZADO",
        audited="AUDITADO",
        batch_closed="BAIXA EM LOTE",
        finished="Finalizada",
        cancelled="Cancelada",
        finished_variant="Finalizado",
        doubt_queue="DÚVIDA",
        unknown_queue="Desconhecida",
        unlisted_queue="Distribuição",
        audit_queue="AUDITORIA - CADASTRO",
        distribution_queues=(
            f"DISTRIBUIÇÃO - {tenant} + JV",
            "DISTRIBUIÇÃO - JV CÍVEL",
            "DISTRIBUIÇÃO - PRÉ CADASTRO",
            "DISTRIBUIÇÃO - PRÉ CADASTRO - JV",
            "DISTRIBUICAO",
        ),
        registration_excluded_queues=(
            "OFICIOS",
            "PRE CADASTRO E DIJUR",
            "PRE CADASTRO E DIJUR - JV",
            "CADASTRO DE ÓRGÃOS E OFÍCIOS",
            "CADASTRO ANS (AUTO DE INFRAÇÃO)",
        ),
        pre_registration_queues=("PRE CADASTRO E DIJUR", "PRE CADASTRO E DIJUR - JV"),
        official_letter_queue="OFICIOS",
        agency_queue="CADASTRO DE ÓRGÃOS E OFÍCIOS",
        email_queue="CADASTRO E-MAIL",
        email_other_queues=("OFICIOS", "CADASTRO DE ÓRGÃOS E OFÍCIOS"),
        queue_groups=(
            ("CAPTURA ANTECIPADA", (" CADASTRO ROBÔ", "INCIDENTE PROCESSUAL", "CADASTRO ANS")),
            ("SHAREPOINT", ("CADASTRO SHAREPOINT", "ATUALIZAÇÃO - SHAREPOINT")),
            ("CITAÇÃO ELETRÔNICA",
             ("CADASTRO CITAÇÃO ELETRÔNICA", "ATUALIZAÇÃO CITAÇÃO ELETRÔNICA")),
            ("E-MAIL", ("CADASTRO E-MAIL", "OFICIOS E-MAIL", "CADASTRO DE ÓRGÃOS E OFÍCIOS")),
            ("PRE CADASTRO E DIJUR", ("PRE CADASTRO E DIJUR",)),
        ),
        other_group="OUTROS",
        robot_user=f"robohub_{tenant.lower()}",
        external_marker="_ter",
        best_excluded=best_excluded,
        fast_portfolio=fast_portfolio,
        portfolio_closed="FINALIZADO",
        portfolio_reclassified="RECLASSIFICADO",
        portfolio_in_progress="ANDAMENTO_PRE",
        no_deviation="sem desvio",
        dropped_columns=(
            "ID NIP", "M.O.", "Nº LB (JV - CÍVEL)", f"Nº LB ({tenant} - CÍVEL)",
            "Nº LB (JV TRABALHISTA)",
        ),
    )
