"""Whole stages as DataFrame plans: shots, context, candidate sequences, answers, manifests, time bins, identities, targets,
assignments, the final table, and reports on it."""
