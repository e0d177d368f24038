"""wayfield: drive-test coverage analytics as Spark jobs.

``functions`` holds Column expressions, ``sources`` readers and writers,
``operators`` DataFrame-to-DataFrame steps, ``plans`` whole runs and
``streaming`` the Structured Streaming forms.
"""
