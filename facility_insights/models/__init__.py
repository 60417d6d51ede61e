"""Fitted transformers and regressions: scaler, kNN imputer, OLS, boosted trees, search, CV."""
