"""terrasample: survey-sampling design, estimation and field-cost analytics on PySpark."""

__version__ = "0.1.0"
