"""Table cleaning, profiling and extraction as Spark DataFrame transforms."""

from rowrinse.options import CleaningOptions
from rowrinse.plans.clean import clean, clean_lite
from rowrinse.plans.profile import profile

__all__ = ["CleaningOptions", "clean", "clean_lite", "profile"]
