"""Functions from DataFrame to DataFrame that know no table."""
