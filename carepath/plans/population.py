"""From the source tables to a cohort folder: selection, target, split, events."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.constants import (
    ICD10_CHAPTERS,
    OUTCOME,
    TASK_LOS_CATEGORICAL,
    TASK_MACE,
    TASK_MORTALITY,
    TASK_PROGNOSIS,
    TASK_REHOSPITALIZATION,
)
from carepath.operators.events import (
    DEFAULT_EVENT_TABLES,
    I2B2_EVENT_TABLES,
    EventTable,
    add_statics,
    create_event_cohort,
    drop_outcome_visit_events,
    make_event_config,
    sample_non_cases,
)
from carepath.operators.features import last_diagnosis_features
from carepath.operators.selection import SelectedPopulation, add_criterion, select_population
from carepath.operators.splits import split_train_test_w_hospital_ids, split_train_test_w_inclusion_start
from carepath.operators.tasks import NaivePrognosisBaseline, create_outcome, target_chapter
from carepath.session import materialise


@dataclass(frozen=True)
class CohortConfig:
    """Everything that defines a cohort. The three tasks below are its usual settings."""

    cohort_name: str
    task_name: str
    study_start: datetime = datetime(2017, 1, 1)
    study_end: datetime = datetime(2022, 6, 1)
    min_age_at_admission: float = 18
    sup_quantile_visits: float = 0.95
    n_min_visits: int = 1
    horizon_in_days: int = 30
    with_incomplete_hospitalization: bool = False
    visits_w_billing_codes_only: bool = False
    index_visit: str = "random"
    max_time_delta_day: float = 1
    running_max: bool = False
    session_level: bool = False
    los_categories: tuple[float, ...] = (0, 7, math.inf)
    cim10_nb_digits: int = 1
    min_prevalence: float = 0.01
    random_state: int = 0
    chapter: str | None = None
    event_tables: dict[str, EventTable] = field(default_factory=lambda: make_event_config(DEFAULT_EVENT_TABLES))
    n_min_events: int = 10
    test_size: float = 0.2
    # leave out the events before the study
    events_from_study_start: bool = False
    # persons without the outcome to write next to all cases; none without a number
    n_non_cases: int | None = None
    hospital_names_test: tuple[str, ...] = ()


def cohort_folder(config: CohortConfig) -> str:
    """Name of the folder of a cohort, from what sets it apart."""
    task = config.task_name
    if task == TASK_LOS_CATEGORICAL:
        task += f"@{len(config.los_categories)}"
    elif task == TASK_PROGNOSIS:
        task += f"@cim10lvl_{config.cim10_nb_digits}__rs_{config.random_state}__min_prev_{config.min_prevalence}"
        if config.chapter is not None:
            task += f"chap_{config.chapter}"
    elif task in (TASK_MACE, TASK_MORTALITY, TASK_REHOSPITALIZATION):
        task += f"@{config.horizon_in_days}"
    period = f"{config.study_start.year}_{config.study_end.year}"
    return (
        f"{config.cohort_name}__age_min_{config.min_age_at_admission}__dates_{period}"
        f"__task__{task}__index_visit_{config.index_visit}"
    )


LOS_COHORT = CohortConfig("complete_hospitalization_los", TASK_LOS_CATEGORICAL)
PROGNOSIS_COHORT = CohortConfig(
    "icd10_prognosis", TASK_PROGNOSIS, horizon_in_days=7, n_min_visits=2,
    with_incomplete_hospitalization=True, visits_w_billing_codes_only=True,
)
MACE_COHORT = CohortConfig(
    "mace", TASK_MACE, datetime(2018, 1, 1), datetime(2020, 12, 31), horizon_in_days=360, n_min_visits=2,
    with_incomplete_hospitalization=True, visits_w_billing_codes_only=True,
    event_tables=make_event_config(I2B2_EVENT_TABLES), events_from_study_start=True, n_non_cases=4000,
)


@dataclass
class Cohort:
    population: SelectedPopulation
    target: DataFrame
    dataset_split: DataFrame
    person: DataFrame
    event: DataFrame
    funnel: DataFrame
    steps: list[str]
    # further tables by name: hospital split, chapters of the index stay, case-control sample
    more: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, folder: str) -> None:
        tables = {
            "inclusion_criteria": self.population.inclusion_population,
            "target": self.target,
            "dataset_split": self.dataset_split,
            "person": self.person,
            "event": self.event,
            "funnel": self.funnel,
            **self.more,
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet", compression="snappy")


def build_cohort(
    database, config: CohortConfig, icd10_tree: DataFrame | None = None, care_sites: DataFrame | None = None
) -> Cohort:
    """Select, define the target, split by date and gather the events of a cohort.

    A split by hospital needs the hierarchy of the care sites.

    The population and the target feed what follows, so they are written once.
    """
    population = select_population(
        database, config.study_start, config.study_end, config.min_age_at_admission, config.sup_quantile_visits,
        config.n_min_visits, config.visits_w_billing_codes_only, config.horizon_in_days,
        config.with_incomplete_hospitalization, config.index_visit, config.max_time_delta_day, config.random_state,
        running_max=config.running_max, session_level=config.session_level,
    )
    target = create_outcome(
        database, population.inclusion_population, config.horizon_in_days, config.task_name, config.los_categories,
        config.study_end, config.cim10_nb_digits, config.min_prevalence, config.random_state, icd10_tree,
    )
    if config.chapter is not None:
        target = target_chapter(target, config.chapter)
    target = materialise(target, "target")
    funnel, steps = population.funnel, list(population.steps)

    def step(passing: DataFrame, name: str) -> None:
        nonlocal funnel
        funnel = add_criterion(funnel, passing, len(steps))
        steps.append(name)

    if config.task_name == TASK_MACE:
        step(target, f"No MACE at index visit ({config.index_visit})")
    statics = add_statics(target, database)
    split = split_train_test_w_inclusion_start(statics, config.test_size)
    since = config.study_start if config.events_from_study_start else None
    person, event = create_event_cohort(statics, database, config.event_tables, since, config.n_min_events)
    step(person, f"< {config.n_min_events} events logged")
    more = {}
    if config.task_name == TASK_PROGNOSIS:
        event = drop_outcome_visit_events(event, person)
        if icd10_tree is not None:
            chapters = NaivePrognosisBaseline(event, icd10_tree, last_visit=True).predict(person)
            more["index_stay_chapters"] = last_diagnosis_features(chapters, list(ICD10_CHAPTERS))
    if config.task_name == TASK_MACE:
        step(person.filter(F.col(OUTCOME) == 1), f"MACE at {config.horizon_in_days}")
    if config.hospital_names_test:
        more["hospital_split"] = split_train_test_w_hospital_ids(
            database, statics, config.study_start, config.study_end, list(config.hospital_names_test), care_sites
        )
    if config.n_non_cases is not None:
        sample, sampled = sample_non_cases(person, event, split, config.n_non_cases, config.random_state)
        more[f"person_{config.n_non_cases}_non_cases"] = sample
        more[f"event_{config.n_non_cases}_non_cases"] = sampled
    return Cohort(population, target, split, person, event, funnel, steps, more)
