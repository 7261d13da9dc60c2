"""mooring: query-local evidence selection and nested-record analytics on Spark."""

__version__ = "0.1.0"
