"""Input tables, artefact readers and writers, and the study's fixed values."""
