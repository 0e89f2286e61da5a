"""phyllon: Spark jobs for plant-image data sets, diagnoses and treatment orders."""
