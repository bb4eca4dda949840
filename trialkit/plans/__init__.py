"""Study steps: cohorts, arms, features, outcomes, matching, survival, synthesis."""
