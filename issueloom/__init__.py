"""Issue triage as Spark jobs: landed JSON pages in, ranked report tables out."""

__version__ = "0.1.0"
