"""Notes worded by hand, none taken from tables or from the training frames; personal items are marked <type:text>."""

NOTES = """The patient, <name:Margaret Oduya>, arrived by ambulance shortly after midnight.
I reviewed <name:Samuel Whitlock> in the outpatient department and he remains well.
Many thanks for asking me to see this pleasant gentleman, <name:Arthur Penrose>.
Please phone his daughter <name:Lucy Penrose> on <phone:020 7946 0812> once the results are back.
He can be emailed at <email:arthur.penrose@example.org>.
Her new address is <address:14 Larchfield Road>, Reading.
They live at <address:220 Quarry Hill> with two cats.
Medical record number <id_number:00482913> was updated.
NHS number <id_number:943 476 5919> confirmed with the relative.
Policy <id_number:QX-99812-AA> has lapsed.
His passport (<id_number:C4471290>) was returned to him.
Social security number on the form: <id_number:412-55-9087>.
Care was handed to Dr <name:Helen Abara>, who will repeat the bloods.
Discussed with the surgical registrar, Mr <name:Tendulkar>, by telephone.
Ms. <name:Ramirez> was tearful but consolable.
The interpreter, <name:Yusuf Demir>, was present throughout.
Contact the practice manager at <email:manager(at)northpark.invalid> about the form.
Her sister can be reached at <phone:(312) 555-0142> during office hours.
Nurse <name:Bianca Fell> removed the cannula.
A copy goes to <name:O'Leary, Fiona>.
Witnessed by <name:K. Brandt> and <name:P. Osei>.
Mrs <name:van der Berg> lost her glasses on the ward.
The Babinski sign was negative and the Glasgow Coma Scale was 15.
Lot 4471-90-22 of the vaccine was used on 3 March 2021.
He takes Metformin and Ramipril every morning.
Parkinson disease was diagnosed by a colleague in 2016.
Crohn disease is quiescent on Azathioprine.
Chest X-ray showed no focal consolidation in the Right Upper Lobe.
The Foley catheter was changed after 12 days.
Transferred from Queen Elizabeth Hospital to the Stroke Unit.
Haemoglobin 10.2, white cells 7.8, platelets 230.
Device serial 77120934 was interrogated.
SSN xxx-xx-4471 shown masked.
The MRI of the Lumbar Spine is booked for Thursday.
Give 5 ml every 6 hours for 10 days.
Registered as NCT04512345 in the trial database.""".split("\n")
