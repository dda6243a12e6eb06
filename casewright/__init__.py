"""casewright: checklist-driven information extraction over document collections, on Spark."""
