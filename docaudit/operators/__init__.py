"""DataFrame operators: claims, contradictions, audits, run log, questions, tracks, assembly."""
