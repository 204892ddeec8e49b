"""caselight: adverse-event case-report analytics as Spark jobs.

Layers, lowest first:

* ``fixed_values``  column lists, word lists and bin edges of the public feed
* ``functions``     Column builders (cleaning, derived fields, scores)
* ``sources``       CSV feed reader, bronze tables, model store, star-table adapter
* ``plans``         raw tables -> case model, and the checks that guard a publish
* ``operators``     filters, drill-downs, panels, significant terms, case page,
                    dossier, field profile
* ``streaming``     empty: the feed has no stream; increments are replaced files
"""
