"""Front ends: pipelines over datasets, research frames over feeds, definitions, groups and rankings of factors."""
