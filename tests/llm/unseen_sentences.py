"""Sentences made up for the tests, none taken from the corpus. They are not blind: their author had written the lexicon and had seen which phrases it finds in the corpus.

None was changed or dropped after its first run.
"""

ABUSIVE = """
Honestly, you're the dumbest idiot I have ever had to work with.
Your face looks like a dropped pie, you ugly cow.
Get out of my sight, you lying piece of trash.
You're pathetic and everybody laughs behind your back.
Oh please, go hang yourself already.
I swear I will burn your house down and kill you all.
One of these days I'm gonna smash his face in.
You better sleep with one eye open, because I know where you live.
If she talks again I will cut her throat.
Somebody ought to shoot that referee.
I hope your whole family dies in a fire.
These people are nothing but parasites.
All Muslims are terrorists and should be shot.
Gypsies are born thieves, throw them out.
Women like that deserve to be raped.
The refugees are an infestation.
Go back to your own country, you filthy immigrant.
Gays should be locked up.
We ought to gas the whole lot of them.
You fukcing retrad.
What a b@stard he is, that stupid jerkoff.
sh1thead, nobody wants you here
You are a m o r o n.
uglyyy btich, shut your mouth
He shoved his cock deep into her mouth.
I want you naked on my bed tonight, begging for it.
Let me grab your tits and ride you all night.
Suck it, slut, and swallow.
She moaned while he licked her nipples.
Wanna see my dick pics?
Halt einfach dein dummes Maul, du Missgeburt.
Ich schlage dir die Zähne aus.
Ihr seid alle Ungeziefer.
Geh doch sterben, du wertloser Versager.
Ferme ta gueule, sale pute.
Je vais te casser la gueule.
Tu es vraiment un pauvre con.
Cállate, imbécil, nadie te quiere.
Vete a la mierda, gilipollas.
Ojalá te mueras, cerdo asqueroso.
kill urself, the planet needs the air
End your life, it is worthless anyway.
You should have been drowned at birth.
Drop dead, you miserable old hag.
I'd enjoy watching you bleed.
They ought to string up every last one of those faggots.
Look at this brainless clown, what a loser.
stupid whores, all of them
You make me want to vomit, you disgusting slob.
Eat shit and die.
""".strip().splitlines()

HARMLESS = """
The surgeon cut the cord and handed the baby to the mother.
I could have died laughing at that clown in the circus.
The word bitch originally meant a female dog.
He was beaten by two seconds in the final race.
Please kill the lights before you leave.
She plays a killer in the new series.
The pig was slaughtered and the meat was smoked.
Do not call other users idiots or morons.
The jury heard that he had threatened to kill her.
My grandmother bakes a killer apple pie.
Rats are kept as pets in many homes.
The virus spreads through dirty water.
He feels stupid for having missed the train.
Don't beat yourself up about the exam.
The naked mole rat lives underground.
Sex and age of each subject were noted.
A cockpit voice recorder was found in the wreck.
Dick and Fanny went to the market in Scunthorpe.
The weak signal was drowned out by noise.
I hate it when the bus is late.
You are killing it on the guitar these days!
We shot the last scene near the harbour.
The dumb waiter carries plates to the first floor.
Lice are treated with a special shampoo.
The hospital treats victims of rape and torture.
A bastard file has a medium coarse cut.
The donkey kicked the farmer and broke his leg.
She got a kick out of the story.
It would be silly to burn the old letters.
The author describes the hanging of the last pirates.
Shut the window, it is freezing.
You look sick, you should see a doctor.
Foreigners need a visa to work here.
Refugees are waiting for food and shelter.
The women are all engineers.
We hope that nobody gets hurt in the storm.
I know where you can park for free.
The city would be better without cars.
Watch your head when you go down.
The bill was killed in the senate.
Der Film zeigt, wie ein Mann stirbt.
Die Ratten im Keller sind weg.
Das Schwein quiekte laut im Stall.
Le chien est sale après la promenade.
La tue-mouche est une amanite toxique.
El cerdo es un animal inteligente.
La puta es un insulto en español, dice el diccionario.
Someone spat the insult moron at the referee and was banned.
Breast milk is best for newborn babies.
The bomb squad exploded the old shell safely.
""".strip().splitlines()

#: Written after the lexicon had been widened by what the lists above showed.
ABUSIVE_LATER = """
Are you really this stupid or are you just pretending, you halfwit?
I can't stand that smug bastard from accounting.
You're a disgrace and a coward.
Your existence is a mistake, do everyone a favour and disappear.
Say that again and I will knock your teeth out.
My brothers and I are going to beat you senseless tonight.
He deserves to be hanged in public.
I pray that she dies of cancer.
Nobody would notice if you died.
Put a gun to your head and kill yourself.
Those migrants are vermin, all of them.
Black people are apes.
Lesbians should be burned alive.
Christians ought to be wiped out.
Kill all the Jews.
Filthy gypsies, go back to where you came from.
She rode his dick until he came inside her.
Come over and let me lick your pussy, baby.
Free porn videos here, hot sex all night.
I am so horny, take off your panties and spread your legs.
wtf is wrong with you, dumbazz
Y0u are a w0rthle$$ p1ece of sh1t
Shut up you stuppid whor
Du verdammter Hurensohn, verpiss dich!
Ich hoffe, du verreckst elendig.
Ausländer raus, ihr Dreckschweine!
Espèce de salope, va mourir.
Sale arabe, rentre dans ton pays.
Maldito maricón, te voy a partir la cara.
Los inmigrantes son ratas.
""".strip().splitlines()

HARMLESS_LATER = """
You can kill two birds with one stone here.
The bishop was beheaded in 1535.
Cows, pigs and donkeys grazed on the meadow.
This trash bag is full, please take it out.
We need to beat the deadline.
The referee was insulted by a fan who called him a bastard.
Patients with cancer often hope for a cure.
The vet examined the bitch and her seven puppies.
The naked truth is rarely pleasant.
My phone is dead and I hate it.
Would you shoot the second take from above?
You are the worst singer in the choir, said his sister with a grin.
He gave a moving speech about refugees and migrants.
You would be sorry to miss the show.
The worm is in the apple.
She was sick with worry about her son.
The ape reached for the banana.
The monkey took the hat from the woman.
Hit the ball with your left hand.
Slap some paint on that wall.
Choke points in the pipeline slow the pump down.
She hung the picture and left.
In German, dumm means stupid.
Er schlägt die Eier schaumig.
Das Kind ist krank und müde.
La rate est un organe.
Il va tuer le temps au café.
Voy a matar el tiempo leyendo.
El perro sucio entró en la casa.
Discussions of sex and gender are part of the course.
""".strip().splitlines()
